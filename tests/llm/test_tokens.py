from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import huffman
from ledgerloom.llm.chunks import ChunkCache
from ledgerloom.llm.id_cache import IdCache
from ledgerloom.llm.token_counts import token_counts
from ledgerloom.llm.token_files import read_token_files, token_file_digests, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "\n", "\n\n", "a", " a", "a ", "a b", "a  b", "a\nb", "a \n b", "\na", " \na\n", "a\r\nb", "a\tb \t c", "x\x0by",
    "a\xa0 b", "\xa0 b", "a \xa0b", "a b", "é\x1c b", "it's don't  we'll 's", "1234 567!?! ...\n\n  end", "<|endoftext|> a <|endoftext|>b",
    "日本語 テキスト　空白", "😀 😀‍😀", "a\x85 b", "٣٤ ⅷ x²", "\\ \x1e b", "A" * 5000, " " * 999 + "x", "\tfoo", "a \tfoo", "\rfoo a", "a \rfoo",
]


def _expected(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_equal_whole_texts():
    draw = random.Random(3)
    parts = [" ", " ", " ", "\n", "\t", "\r", "\v", "\xa0", " ", "\x1c", "a", "Word", "don't", "12", ".", "é", "日本", "<|endoftext|>", "'s"]
    texts = [x or "" for x in ODD] + ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(4000)]
    expected = _expected(texts)
    for path_most in (10, 10_000_000):
        cache = ChunkCache(PATH, list, most=path_most)
        for lo in range(0, len(texts), 50):
            for keys, ids in zip(cache.fill(texts[lo : lo + 50]), expected[lo : lo + 50]):
                assert [i for k in keys for i in cache[k]] == ids


def test_ids_as_bytes_equal_whole_texts():
    draw = random.Random(4)
    parts = [" ", " ", " ", "\n", "\t", "\r", "\v", "\xa0", "\u3000", "\x1c", "a", "Word", "don't", "12", ".", "é", "日本", "<|endoftext|>", "'s"]
    texts = [x or "" for x in ODD] + ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(4000)]
    expected = _expected(texts)
    for most in (10, 10_000_000):
        cache = IdCache(PATH, "<u2", most=most)
        assert cache.words
        for lo in range(0, len(texts), 50):
            for raw, ids in zip(cache.ids(texts[lo : lo + 50]), expected[lo : lo + 50]):
                assert np.frombuffer(raw, "<u2").tolist() == ids
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = IdCache(path, "<u4")
    assert not cache.words
    t = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids(["A b  c", ""])] == [t.encode(x, add_special_tokens=False).ids for x in ("A b  c", "")]


def test_vocabulary_beyond_the_code_limit():
    counts = np.ones(300_000, np.int64)
    lengths = huffman.code_lengths(counts, max(18, len(counts).bit_length()))
    ids = np.arange(0, 300_000, 7)
    payload, checkpoints = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    assert lengths.max() == 19 and huffman.decode(payload, checkpoints, len(ids), huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_one_doc_id_spreads_over_files(spark, tmp_path):
    df = spark.range(2000).selectExpr("7L as doc_id", "concat('same text ', id % 3) as text")
    write_token_files(df, str(tmp_path / "hot"), PATH)
    blocks = spark.read.parquet(str(tmp_path / "hot/blocks"))
    assert blocks.select("file").distinct().count() > 2
    found = read_token_files(spark, str(tmp_path / "hot")).orderBy("start").collect()
    assert len(found) == 2000 and found[-1].start == sum(r.n_tokens for r in found[:-1])


def test_staged_ids_are_compressed(spark, tmp_path, monkeypatch):
    """The staged ids of texts without repeats take less than two bytes each."""
    draw = random.Random(4)
    df = spark.createDataFrame([(i, "".join(draw.choices("etaoinshr d", k=20_000))) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr("ledgerloom.session.shared_folder", lambda _: str(tmp_path / "kept"))
    write_token_files(df, str(tmp_path / "out"), PATH)
    total = spark.read.parquet(str(tmp_path / "out/blocks")).agg({"n_tokens": "sum"}).first()[0]
    assert sum(p.stat().st_size for p in (tmp_path / "kept").rglob("*.parquet")) < 1.8 * total


def test_other_tokenizers_are_not_cut():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, cache = Tokenizer.from_file(path), ChunkCache(path, list)
    texts = ["A b  c", "", "don't\nstop"]
    assert cache.whole
    for keys, x in zip(cache.fill(texts), texts):
        assert [i for k in keys for i in cache[k]] == t.encode(x, add_special_tokens=False).ids


def test_code_lengths_are_optimal_and_limited():
    import heapq

    draw = np.random.default_rng(1)
    counts = draw.integers(0, 1000, 300) ** 3
    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    depth = np.zeros(300, np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        depth[x + y] += 1
        heapq.heappush(heap, (a + b, x + y))
    assert (counts * huffman.code_lengths(counts, 40)).sum() == (counts * depth).sum()
    short = huffman.code_lengths(counts, 9)
    assert short.max() <= 9 and sum(2.0 ** -short[short > 0]) == 1
    assert huffman.code_lengths(np.array([0, 5]), 4).tolist() == [0, 1]
    assert huffman.code_lengths(np.zeros(3, int), 4).tolist() == [0, 0, 0]


def test_encode_decode():
    draw = np.random.default_rng(2)
    for n, kinds in ((0, 5), (1, 1), (127, 2), (128, 50_000), (50_001, 50_000), (400, 1)):
        ids = (draw.random(n) ** 6 * kinds).astype(np.int64)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=1), 18)
        payload, checkpoints = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
        assert huffman.decode(payload, checkpoints, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_counts_and_files_on_whole_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = sorted(df.collect())
    ids = [x + [2] for x in _expected([r.text for r in rows])]
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()}
    assert counted == {r.doc_id: (len(r.text.encode()), len(x) - 1, len(x) - 1 > 512) for r, x in zip(rows, ids)}
    expected, before = {}, 0
    for r, x in zip(rows, ids):
        expected[r.doc_id] = (before, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        before += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file_digests(df, PATH).collect()} == expected


def test_odd_rows(spark, tmp_path):
    rows = [(i, x, i) for i, x in enumerate(ODD)] + [(3, "again", 0), (None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    order = sorted(zip([r[0] for r in rows], _expected([r[1] for r in rows])), key=lambda r: (-1 if r[0] is None else r[0]))
    assert sorted(r.n_tokens for r in token_counts(df, PATH).collect()) == sorted(len(x) for _, x in order)
    write_token_files(df, str(tmp_path / "a"), PATH, block_tokens=100)
    found = read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [d for d, _ in order]
    assert sorted((repr(r.doc_id), r.ids) for r in found) == sorted((repr(d), x + [2]) for d, x in order)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert token_counts(df.limit(0), PATH).collect() == [] and token_file_digests(df.limit(0), PATH).collect() == []
