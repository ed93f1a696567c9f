"""Token ids of texts through a cache of their chunks, the same as the library gives for whole texts.

Byte-level pre-tokens never go from a non-space character over into white space. So a text
can be cut before every run of white space, and a chunk (its white space, then a run of
other characters) is encoded alike wherever it stands. Most chunks of a corpus recur.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from tokenizers import Tokenizer

# Characters with the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
# Cached chunks a process; at about 200 bytes each.
MOST_CACHED = 1_000_000

_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once a process, without truncation or padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def cuttable(path: str) -> bool:
    """Whether a file's tokenizer is byte-level with the usual pattern, so that chunks are encoded alone."""
    made = json.loads(tokenizer(path).to_str())
    split = made.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    marks = any(t.get("lstrip") or t.get("rstrip") or not t["content"].strip() for t in made.get("added_tokens", []))
    return bool(plain and not made.get("normalizer") and not marks)


class ChunkCache(dict):
    """``value(ids)`` of every chunk met, under its key. Chunks not met yet are encoded in batches.

    ``known``: values of frequent chunks, kept when the rest is dropped at ``most`` entries.

    The first character of a key says what is encoded: carriage return, the first chunk of a
    text; vertical tab, a chunk from the careful cut; tab, a whole text that is not cut; line
    break, a chunk as it stands; any other, a space and the key.
    """

    def __init__(self, path: str, value: Callable, known: dict | None = None, most: int = MOST_CACHED):
        super().__init__()
        self.tokenizer, self.value, self.known, self.most = tokenizer(path), value, known or {}, most
        self.whole = not cuttable(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.once: list[str] = []

    def chunks(self, text: str) -> list[str]:
        """Keys of a text by the quick cut, which serves texts whose white space is single."""
        if self.whole or any(m in text for m in self.marks):
            self.once.append("\t" + text)
            return self.once[-1:]
        if "\r" in text or "\t" in text or "\v" in text:
            return self.careful(text)
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = "\r" + cut[0]
        return cut

    @staticmethod
    def careful(text: str) -> list[str]:
        """Keys of a text by the cut before every run of white space."""
        return ["\v" + c for c in _CHUNK.findall(text)]

    @staticmethod
    def unsafe(key: str) -> bool:
        """Whether a key of the quick cut stands in a longer run of white space."""
        return not key or key[0] not in "\v\t" and (key[-1].isspace() or (key[0].isspace() and key[0] not in "\r\n"))

    def fill(self, texts: list[str]) -> list[list[str]]:
        """Keys of each text, all of them cached until the next call."""
        for key in self.once:
            self.pop(key, None)
        self.once = []
        if len(self) > self.most:
            self.clear()
        if not self:
            self.update(self.known)
        keys = [self.chunks(t) for t in texts]
        new = {k: None for own in keys for k in own if k not in self}
        unsafe = {k for k in new if self.unsafe(k)}
        if unsafe:
            keys = [own if unsafe.isdisjoint(own) else self.careful(t) for own, t in zip(keys, texts)]
            new = {k: None for own in keys for k in own if k not in self}
        plain = [k[1:] if k[0] in "\r\t\v" else k if k[0] == "\n" else " " + k for k in new]
        for k, e in zip(new, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            self[k] = self.value(e.ids)
        return keys
