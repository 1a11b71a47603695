"""Vectorised text primitives over Arrow string buffers.

Every operator that needs word positions or shingle hashes runs these functions inside
``mapInArrow``/``applyInArrow``: they look at the UTF-8 bytes of a whole slice of rows at once, so no
Python object is made per word.  Memory is bounded by ``SLICE_BYTES`` (or one row, if a row is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 2_000_000
SLICE_ROWS = 60_000
U64 = np.uint64


def release() -> None:
    """Free memory goes back to the system: workers are used again, and idle ones would keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A function of a key and its table, after which free memory goes back."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        release()
        return out

    return whole


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table that is True for the byte values in the (inclusive) ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Word separators of the contracts: space and \t..\r for plain words; every ASCII non-alphanumeric for benchmark words.
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
NON_ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls (null becomes empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (relative to the returned bytes) of a large_string array."""
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES (or ``most``) bytes and SLICE_ROWS rows, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + (most or SLICE_BYTES), side="right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, n)
        yield lo, hi
        lo = hi


def word_spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of the maximal runs of non-separators; rows bound runs."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class WordHash:
    """A 64-bit polynomial hash of words and of word sequences; seeds give independent functions."""

    def __init__(self, seed: int) -> None:
        with np.errstate(over="ignore"):
            self.table = mix(np.arange(1, 257, dtype=U64) + U64(seed * 1_000_003))
            self.base = mix(np.array([seed * 7 + 1], dtype=U64))[0] | U64(1)
            self.step = mix(np.array([seed * 7 + 2], dtype=U64))[0] | U64(1)
        self.powers = np.full(1, self.base, dtype=U64)

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        lens = ends - starts
        if (most := int(lens.max())) > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(2 * most, self.base, dtype=U64), dtype=U64)
        first = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
        at = pos + np.repeat(starts, lens)
        with np.errstate(over="ignore"):
            values = self.table[raw[at]] * self.powers[pos]
            return mix(np.add.reduceat(values, first) + lens.astype(U64))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words that start at each word; the last k - 1 entries are left out."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out *= self.step
                out += words[j : j + n]
            return mix(out + U64(k))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes of the least width that holds them."""
    values = np.ascontiguousarray(values, dtype=U64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(4, "little") + bytes([width]) + zstandard.compress(planes, 1)


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    planes = np.frombuffer(zstandard.decompress(blob[5:]) if n else b"", dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(U64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """As pack(), for ascending values: the first and then the gaps."""
    values = np.ascontiguousarray(values, dtype=U64)
    return pack(np.diff(values, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(blob), dtype=U64)


def join_blobs(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(4, "little") + b for b in blobs)


def split_blobs(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """Spark's ``pmod(hash(id), groups)`` of long ids: Murmur3 with seed 42."""
    ids = ids.astype(np.int64).view(U64)
    lo, hi = (ids & U64(0xFFFFFFFF)).astype(np.uint32), (ids >> U64(32)).astype(np.uint32)
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(ids), 42, np.uint32)
        for k in (lo, hi):
            k = rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % groups


@functools.lru_cache(maxsize=4)
def range_keys(ranges: int, negative: bool = False) -> np.ndarray:
    """A key for each hash range (or group) such that Spark's hash deals each to a partition of its own; all of them below 0 if asked for."""
    tried = np.arange(ranges * (8 + 2 * ranges.bit_length()), dtype=np.int64)
    tried = -1 - tried if negative else tried
    bucket, first = np.unique(group_of(tried, ranges), return_index=True)
    out, found = np.zeros(ranges, np.int64), np.zeros(ranges, bool)
    out[bucket], found[bucket] = tried[first], True
    rest = np.flatnonzero(~found)  # partitions that no key was found for: another one gets two ranges
    out[rest] = (-1 - len(tried) - rest) if negative else len(tried) + rest
    return out


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
