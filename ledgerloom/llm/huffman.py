"""Canonical length-limited Huffman codes for token ids, written and read in numpy."""

from __future__ import annotations

import numpy as np

# Tokens between two checkpoints; all stretches between checkpoints are decoded side by side.
STRETCH = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of every symbol with a count, 0 for others; none is longer than ``limit``.

    Package-merge: ``limit`` times, pair up neighbours and merge the pairs with the symbols;
    a symbol's length is how often it is in the cheapest 2 n - 2 packages.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, levels, row = len(order), [], weight
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        row = both[rank]
    # From the last level back: of the taken packages, symbols count once and pairs open the level below.
    taken = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:taken].sum())
        lengths[:symbols] += 1
        taken = 2 * (taken - symbols)
    lengths[:taken] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order]
    if len(own):
        top = int(own[-1])
        at = np.concatenate([[0], np.cumsum(1 << (top - own))[:-1]]).astype(np.int64)
        codes[order] = (at >> (top - own)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for every window of as many bits as the longest code has."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (top - lengths[order])
    symbols = np.zeros(1 << top, np.uint32)
    sizes = np.ones(1 << top, np.uint8)
    symbols[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return symbols, sizes, top


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids`` and the bit offset of every STRETCH-th of them."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    # Each code lies in a window of 64 bits that begins at a 32-bit word.
    shifted = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    word = starts >> 5
    n = int(ends[-1] + 31 >> 5) + 1
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    packed = (high[:n] + low[:n]).astype(np.uint32).astype(">u4")
    return packed.tobytes(), starts[::STRETCH].astype(np.uint32)


def decode(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block; every stretch starts at its checkpoint and steps with the others."""
    symbols, sizes, top = table
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    windows = np.concatenate([words, [0]]).astype(np.uint64)
    windows = (windows[:-1] << np.uint64(32)) | windows[1:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((STRETCH, len(at)), np.uint32)
    last = len(windows) - 1
    shift = np.uint64(64 - top)
    for step in range(STRETCH):
        peek = (windows[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift
        out[step] = symbols[peek]
        at += sizes[peek]
    return out.T.reshape(-1)[:n]
