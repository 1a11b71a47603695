"""Packing by cutting-stock column generation.

Documents become token ids, are cut into pieces of ``capacity`` and a rest, and the histogram of piece lengths
(in steps of ``STEP`` tokens) is a cutting-stock problem: columns are patterns of lengths that fit one
sequence.  A linear program chooses how often each pattern is used; its duals price new patterns with a
knapsack dynamic program until none improves it.  Rounded-down pattern counts, and greedy patterns for the few pieces
that rounding leaves, are dealt to the pieces by their rank within their length.

Only the histogram (at most capacity / STEP counts) and the patterns (bounded by it) are on the driver.  Ranks
are taken within (length, salt) groups, so a frequent length is not one task.

Edge cases: null and empty texts have the end id alone, one piece; rows that repeat a doc_id (also a null one) are packed
as documents of their own; equal pieces tie and take neighbouring ranks; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import arrowtext as at
from .workspace import Workspace, partitions

CAPACITY = 2048
STEP = 4
END_ID = 1
#: Columns that the linear program may add; it starts from greedy patterns and stops sooner at its bound.
MOST_COLUMNS = 1500
#: Distinct pieces of text whose ids a worker remembers before it starts afresh.
REMEMBERED = 400_000


# ---- token ids

def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


@functools.lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    """Classes of code points below 0x2070; UNKNOWN ones (and all above) send their text the slow way."""
    table = np.full(0x2071, UNKNOWN, np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    return table


def piece_starts(cp: np.ndarray, kind: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the vocabulary's pieces of text start: words, numbers and signs with one leading space, white space, contractions."""
    n = len(cp)
    first = np.zeros(n + 4, bool)
    first[doc_starts] = True
    change = np.zeros(n + 4, bool)
    change[1:n] = kind[1:] != kind[:-1]
    start = first | change
    solid = kind != SPACE
    # The last of a run of white space before something solid is a piece of its own, or belongs to what follows if it's a space.
    follows = np.flatnonzero(solid[1:] & ~solid[:-1] & ~first[1:n]) + 1
    start[follows - 1] = True
    start[follows[cp[follows - 1] == 0x20]] = False
    # An apostrophe that stands alone takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero(cp == 0x27)
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        b = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        b = np.where(first[quote + 2], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of whole texts.  Each distinct piece of text is encoded once and remembered by its hash."""

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and not token.startswith("<|")}
        self.special = [t.content.encode() for t in self.slow.get_added_tokens_decoder().values()]
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.hasher = at.WordHash(21)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin: list[int] = [0]

    def _learn(self, key: int, piece: bytes) -> int:
        ids = self.merge(piece)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.begin.append(self.used)
        self.known[key] = len(self.begin) - 2
        return len(self.begin) - 2

    def texts(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a slice, without the end id."""
        n = len(off) - 1
        data = raw.tobytes()
        out: list[np.ndarray | None] = [None] * n
        slow = np.zeros(n, bool)
        for token in self.special:
            where = data.find(token)
            while where >= 0:
                slow[np.searchsorted(off, where, side="right") - 1] = True
                where = data.find(token, where + 1)
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        chars = np.concatenate(([0], np.cumsum(np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off[1:]] - np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off[:-1]])))
        kind = _char_classes()[np.minimum(cp, 0x2070)]
        odd = np.flatnonzero(kind == UNKNOWN)
        if len(odd):
            slow[np.searchsorted(chars, odd, side="right") - 1] = True
        if len(cp):
            starts = piece_starts(cp, kind, chars[:-1][chars[:-1] < len(cp)])
            at_byte = np.concatenate(([0], np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))))
            byte_starts = at_byte[starts]
            byte_ends = np.concatenate((byte_starts[1:], [len(raw)]))
            rows = np.searchsorted(off, byte_starts, side="right") - 1
            if slow.any():
                fast = ~slow[rows]
                byte_starts, byte_ends, rows = byte_starts[fast], byte_ends[fast], rows[fast]
            hashes = self.hasher.words(raw, byte_starts, byte_ends)
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED:
                self._forget()
            get, learn = self.known.get, self._learn
            index = np.empty(len(unique), np.int64)
            for i, (key, a, b) in enumerate(zip(unique.tolist(), byte_starts[first].tolist(), byte_ends[first].tolist(), strict=True)):
                k = get(key)
                index[i] = learn(key, data[a:b]) if k is None else k
            begin = np.array(self.begin, np.int64)
            piece = index[inverse]
            size = begin[piece + 1] - begin[piece]
            to = np.cumsum(size) - size
            ids = self.flat[np.arange(int(size.sum())) + np.repeat(begin[piece] - to, size)]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(rows, weights=size, minlength=n).astype(np.int64))))
            for i in range(n):
                if not slow[i]:
                    out[i] = ids[cuts[i] : cuts[i + 1]]
        for i in np.flatnonzero(slow):
            out[i] = np.array(self.slow.encode(data[off[i] : off[i + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        return [np.zeros(0, np.uint32) if x is None else x for x in out]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int):
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            raw, off = at.utf8(at.strings(batch.column(1)))
            for a, b in at.slices(off):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encode.texts(raw[off[a] : off[b]], off[a : b + 1] - off[a])):
                    size = len(ids) + 1
                    for s in range(0, size, capacity):
                        e = min(s + capacity, size)
                        code = zlib.crc32(np.ascontiguousarray(ids[s : min(e, size - 1)]).tobytes())
                        row.append(a + i)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(end, code) if e == size else code)
                        total.append(size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


# ---- the linear program

def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and its counts."""
    order = np.argsort(sizes)
    sizes, values = sizes[order], values[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            worth = best[c - sizes[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], choice[c] = worth[i], i
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Columns of a feasible start: each greedy pattern uses up one size for good, so the columns are triangular in that order."""
    left, columns = demand.astype(float).copy(), []
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        counts, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(open_)[::-1]:
            if sizes[i] <= room:
                counts[i] = min(room // sizes[i], max(1, np.floor(left[i])))
                room -= int(counts[i]) * sizes[i]
        some = np.flatnonzero(counts)
        ratio = left[some] / counts[some]
        k = int(ratio.argmin())
        left[some] = np.maximum(left[some] - ratio[k] * counts[some], 0)
        open_[some[k]] = False
        columns.append(counts)
    return np.array(columns).T


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most: int = MOST_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Patterns and (fractional) uses that cover the demand exactly, within ``gap`` of the fewest sequences (Farley's bound) if ``most`` columns suffice."""
    m = len(sizes)
    if not m:
        return []
    basis = first_basis(sizes, demand, capacity)
    try:
        inverse = np.linalg.inv(basis)
        sound = np.abs(basis @ inverse - np.eye(m)).max() < 1e-6
    except np.linalg.LinAlgError:
        sound = False
    if not sound:  # small demands can make the greedy columns ill-conditioned: start from copies of one size
        basis, most = np.diag((capacity // sizes).astype(float)), most // 5  # such a problem is mostly rounding, done greedily
        inverse = np.linalg.inv(basis)
    x, last = inverse @ demand, basis.copy()
    for k in range(most):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, direction, 1), np.inf)
        step = ratio.min()
        out = int(np.where(ratio <= step + 1e-9, direction, 0).argmax())  # of ties the soundest pivot
        x = x - step * direction
        x[out] = step
        basis[:, out] = pattern
        if k % 100 == 99:
            try:
                inverse = np.linalg.inv(basis)
                sound = np.abs(basis @ inverse - np.eye(m)).max() < 1e-6
            except np.linalg.LinAlgError:
                sound = False
            if not sound:
                basis = last.copy()
                break
            x, last = inverse @ demand, basis.copy()
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    try:
        x = np.linalg.solve(basis, demand)
    except np.linalg.LinAlgError:
        basis = last
        x = np.linalg.solve(basis, demand)
    return [(basis[:, i], float(max(0, x[i]))) for i in range(m)]


def patterns_for(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by size, uses): rounded-down linear-program patterns, then greedy ones for what is left."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(counts: np.ndarray, times: int) -> None:
        out.append(({int(s): int(c) for s, c in zip(sizes, counts, strict=True) if c}, int(times)))
        left[:] -= counts * times

    if len(sizes):
        for pattern, x in column_generation(sizes, left.astype(float), capacity):
            counts = np.rint(pattern).astype(np.int64)
            times = int(np.floor(x + 1e-7))
            some = counts > 0
            times = min(times, int((left[some] // counts[some]).min()))
            if times > 0:
                use(counts, times)
    while left.any():
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and sizes[i] <= room:
                counts[i] = min(left[i], room // sizes[i])
                room -= counts[i] * sizes[i]
        some = counts > 0
        use(counts, int((left[some] // counts[some]).min()))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, rank after the last, copies in the pattern, first sequence, place in the sequence)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for counts, times in patterns:
        place = 0
        for size in sorted(counts, reverse=True):
            lo = used.get(size, 0)
            used[size] = lo + counts[size] * times
            out.append((size, lo, used[size], counts[size], sequence, place))
            place += counts[size]
        sequence += times
    return out


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PACKED for each piece.  Texts are read and encoded once; after that rows of a few longs are dealt."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = picked.mapInArrow(_pieces(tokenizer_path, capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    salts = 2 * partitions(spark)
    size = F.ceil(F.col("length") / STEP).cast("int")
    pieces = ws.save(cut, "pieces").withColumns({"size": size, "salt": F.pmod(F.hash("doc_id", "start", "ids_crc32"), F.lit(salts))})

    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity / STEP rows at most
    table = slots(patterns_for(histogram, -(-capacity // STEP)))
    places = spark.createDataFrame(table, "p_size int, lo long, hi long, copies long, first long, place long")

    counts = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "start", "length", "ids_crc32"))
    ranked = pieces.withColumn("k", inner - 1).join(offsets, ["size", "salt"]).withColumn("rank", F.col("base") + F.col("k"))

    fits = (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(places), fits)  # bounded: the histogram's sizes times the patterns that use them
    nth = F.col("rank") - F.col("lo")
    placed = placed.withColumns({"sequence_id": F.col("first") + F.floor(nth / F.col("copies")).cast("long"), "at": F.col("place") + nth % F.col("copies")})
    earlier = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(*PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
