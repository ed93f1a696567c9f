"""Ids of texts as bytes, through a cache of their chunks that is asked once per chunk."""

from __future__ import annotations

import re

import numpy as np

from .chunks import ChunkCache

# A word of Latin letters, at a text's start or after a space, and the signs that end its chunk.
# Byte-level pre-tokens end where letters turn into signs; an apostrophe may belong to the word.
_WORD = re.compile(r"(\r?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 signs for themselves, then U+0100 on for the rest."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0x100)} - {0xAD}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class IdCache(ChunkCache):
    """Ids of every chunk met, as little-endian bytes of ``dtype``.

    Most chunks not met yet are rare words. The library's model takes them without its
    pre-tokenizer: a word of Latin letters is one pre-token and the signs after it are another.
    All other chunks are encoded whole by the library.
    """

    def __init__(self, path: str, dtype: str, **options):
        super().__init__(path, lambda ids: np.array(ids, dtype).tobytes(), **options)
        self.dtype, self.letters, self.signs = np.dtype(dtype), byte_letters(), {"": b""}
        self.model = self.tokenizer.model
        probe = ["Word", " word", " Naïveté", " zürich"]
        own = [] if self.whole else [self._word(("" if w[0] == " " else "\r") + w.strip()) for w in probe]
        self.words = own == [self.value(ids) for ids in self._encoded(probe)]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, key: str) -> bytes:
        text = key[1:] if key[0] == "\r" else " " + key
        return self.value([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))])

    def _signs(self, text: str) -> bytes:
        if text not in self.signs:
            if len(self.signs) > self.most:
                self.signs = {"": b""}
            self.signs[text] = self.value(self._encoded([text])[0])
        return self.signs[text]

    def _store(self, new: dict) -> None:
        other = []
        for key in new:
            match = _WORD.fullmatch(key) if self.words else None
            if match is None:
                other.append(key)
                continue
            word, signs = match.groups()
            if word not in self:
                self[word] = self._word(word)
            if signs:
                self[key] = self[word] + self._signs(signs)
        plain = [k[1:] if k[0] in "\r\t\v" else k if k[0] == "\n" else " " + k for k in other]
        for key, ids in zip(other, self._encoded(plain)):
            self[key] = self.value(ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        for key in self.once:
            self.pop(key, None)
        self.once = []
        if len(self) > self.most:
            self.clear()
        get = self.get
        keys = [self.chunks(t) for t in texts]
        found = [[*map(get, own)] for own in keys]
        short = [i for i, values in enumerate(found) if None in values]
        new = {k: None for i in short for k, v in zip(keys[i], found[i]) if v is None}
        unsafe = {k for k in new if self.unsafe(k)}
        if unsafe:
            for i in short:
                if not unsafe.isdisjoint(keys[i]):
                    keys[i] = self.careful(texts[i])
                    found[i] = [*map(get, keys[i])]
            new = {k: None for i in short for k, v in zip(keys[i], found[i]) if v is None}
        self._store(new)
        for i in short:
            found[i] = [self[k] if v is None else v for k, v in zip(keys[i], found[i])]
        return [b"".join(values) for values in found]
