"""Words and word shingles of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .memory import trim

SLICE_BYTES = 2 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive slices of about so many bytes. Memory is given back after the last."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, texts.slice(a, b - a)
        a = b
    trim()


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word starts of each text (one more than texts), word codes, and the distinct words by code. Words are runs between ASCII white space; null texts have none."""
    # Copied first: ascii_lower doesn't read slices of large strings rightly.
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    return before[offsets], coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def hashes(distinct: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct), np.uint64, len(distinct))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of each text's shingles, and their hashes, repeats included. A text of fewer than n words, but not none, has one shingle: all its words."""
    starts, codes, distinct = words(texts)
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(starts)
    acc = np.zeros(len(h), np.uint64)
    for k in range(n):  # a window that runs past the end of its text is masked below
        nxt = np.zeros(len(h), np.uint64)
        nxt[: max(0, len(h) - k)] = h[k:]
        acc = acc * _MUL + nxt
    acc = mixed(acc)
    at = np.arange(len(h)) - np.repeat(starts[:-1], count)
    whole = at + n <= np.repeat(count, count)
    short = (count > 0) & (count < n)
    for i in np.flatnonzero(short):
        x = np.uint64(count[i])
        for v in h[starts[i] : starts[i + 1]]:
            x = np.uint64((int(x) * int(_MUL) + int(v)) & 0xFFFFFFFFFFFFFFFF)
        acc[starts[i]] = mixed(np.array([x]))[0]
        whole[starts[i]] = True
    made = np.where(count >= n, count - n + 1, short.astype(np.int64))
    return np.concatenate([[0], np.cumsum(made)]), acc[whole]


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def minhash(starts: np.ndarray, values: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """(texts, count) least hashes; texts without shingles get the largest value."""
    out = np.full((len(starts) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        x, first = (values >> np.uint64(32)).astype(np.uint32), starts[some]
        for j, (a, b) in enumerate(zip(*multipliers(count, seed), strict=True)):
            out[some, j] = np.minimum.reduceat((x ^ b) * a, first)
    return out


def bands(least: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) hashes of consecutive groups of the least hashes, told apart by the group's number."""
    groups = least.reshape(len(least), count, -1).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), groups.shape[:2]).copy()
    for k in range(groups.shape[2]):
        acc = mixed(acc * _MUL + groups[:, :, k])
    return acc.view(np.int64)


def tune(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of so many rows that finds a pair at the threshold with the given probability."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
