"""Substring dedup with a log-structured index of window fingerprints.

A window is 13 consecutive words.  Fingerprints (a 48-bit key and, from an independent hash function, a 24-bit check
value that verifies a matching key) of a batch are sorted by hash range; each range is merge-joined with the sorted, immutable
runs of all earlier batches and learns, for each fingerprint, the least doc_id that it starts in.  A window of a larger
doc_id is repeated, and its words are removed.  What is new in the batch becomes a run itself; when a level holds ``fanout`` runs
they are compacted into one of the next level.

:class:`FingerprintIndex` keeps runs as partitions of a bucketed table: a new batch is shuffled once, history never is.  Its manifest
names the live runs, so an index can be opened again by its folder.  :func:`dedup` takes a table through a new index.

Edge cases: null or empty text has no words, loses nothing and keeps the empty string; a text of fewer
words than the window has no window; windows repeated only within one document stay; documents that
repeat a doc_id count as one source (each row is judged by the others' ids); rows with a null doc_id come neither before nor after
another and lose nothing; extra columns are ignored; an empty table gives an empty result.  A batch is judged by
history and by itself: a later batch with smaller ids doesn't change what an earlier one was told.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Folder, Manifest
from . import arrowtext as at
from .workspace import Workspace, groups_for, shuffles_end_with_the_job

WINDOW = 13
KEY_BITS, CHECK_BITS = 48, 24
FLUSH = 1_500_000
MARK_BITS = 24
U = np.uint64
KEYED = "key long, blob binary, late binary"
#: A row for each hash range: the batch's own run, and for each group of documents what it must remove.
RUN = "key long, run binary, answers array<struct<g: long, blob: binary>>"


def _fingerprints(raw, off, words: at.WordHash, checks: at.WordHash, k: int):
    """Word spans and rows; of each window that is inside one row: its first word, key and check value."""
    starts, ends, rows = at.word_spans(raw, off, at.SPACE)
    hashed = words.words(raw, starts, ends)
    grams = words.windows(hashed, k)
    own = np.flatnonzero(rows[: len(grams)] == rows[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    second = checks.windows(at.mix(hashed ^ checks.base), k)
    return starts, ends, rows, own, grams[own] >> U(64 - KEY_BITS), second[own] >> U(64 - CHECK_BITS)


def _ranged(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(KEY_BITS - 32)) * U(buckets) >> U(32)).astype(np.int64)


def _run_blob(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> bytes:
    ids, local = np.unique(docs, return_inverse=True)
    return at.join_blobs([at.pack_sorted(keys), at.pack(checks), at.pack_sorted(ids.view(U)), at.pack(local)])


def _read_run(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, checks, ids, local = at.split_blobs(blob)
    return at.unpack_sorted(keys), at.unpack(checks), at.unpack_sorted(ids).view(np.int64)[at.unpack(local).astype(np.int64)]


def _keyed(keys: list[int], blobs: list, late: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), pa.array(late, pa.binary())], names=["key", "blob", "late"])


def _runs(ranges: int, k: int):
    """Documents to sorted runs of (key, check, doc), one row for each range and about FLUSH windows.

    A fingerprint leaves with the least of its documents among those windows; the others repeat that one whatever else there is, and
    go, known to be late, to whichever range comes next.  So a window of very many documents costs its range one entry for each
    FLUSH windows.
    """

    def flush(parts: list, turn: int) -> Iterator[pa.RecordBatch]:
        keys, checks, docs, new = _merge([tuple(np.concatenate(x) for x in zip(*parts, strict=True))])
        names = at.range_keys(ranges)
        if not new.all():
            late = ~new
            yield _keyed([int(names[turn % ranges])], [None], [_run_blob(keys[late], checks[late], docs[late])])
            keys, checks, docs = keys[new], checks[new], docs[new]
        cuts = at.bounds(f := _ranged(keys, ranges))
        for a in range(0, len(cuts) - 1, 128):
            some = list(zip(cuts[:-1], cuts[1:], strict=True))[a : a + 128]
            yield _keyed([int(names[f[x]]) for x, _ in some], [_run_blob(keys[x:y], checks[x:y], docs[x:y]) for x, y in some], [None] * len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, parts, held = at.WordHash(11), at.WordHash(12), [], 0
        turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = at.utf8(at.strings(batch.column(1)))
            for a, b in at.slices(off):
                _, _, rows, own, keys, checks = _fingerprints(raw[off[a] : off[b]], off[a : b + 1] - off[a], first, second, k)
                if len(own):
                    parts.append((keys, checks, ids[a:b][rows[own]]))
                    held += len(own)
                if held >= FLUSH:
                    yield from flush(parts, turn)
                    parts, held, turn = [], 0, turn + 7919
        if held:
            yield from flush(parts, turn)

    return run


def _merge(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, check, doc) of several runs, and where each (key, check) starts."""
    keys, checks, docs = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, checks, docs = keys[order], checks[order], docs[order]
    same = np.concatenate(([False], keys[1:] == keys[:-1]))
    tied = np.flatnonzero(same | np.concatenate((same[1:], [False])))  # only repeated keys need the full order
    sub = tied[np.lexsort((docs[tied], checks[tied], keys[tied]))]
    checks[tied], docs[tied] = checks[sub], docs[sub]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
    distinct = new | np.concatenate(([True], docs[1:] != docs[:-1]))
    return keys[distinct], checks[distinct], docs[distinct], new[distinct]


def _least_of_history(least: np.ndarray, keys: np.ndarray, checks: np.ndarray, run: tuple) -> np.ndarray:
    """The least documents of fingerprints after a merge join with an older run."""
    old_keys, old_checks, old_docs = run
    at_, end = np.searchsorted(old_keys, keys, side="left"), np.searchsorted(old_keys, keys, side="right")
    least = least.copy()
    for step in range(int((end - at_).max(initial=0))):  # a key has one check value but for accidents
        here = np.flatnonzero(at_ + step < end)
        here = here[old_checks[at_[here] + step] == checks[here]]
        least[here] = np.minimum(least[here], old_docs[at_[here] + step])
    return least


def _ingest(groups: int):
    """One hash range of a batch against its history: the batch's run, and what repeats an earlier document."""

    def run(key: tuple, batch: pa.Table, history: pa.Table) -> pa.Table:
        answers, mine = [], b""
        if batch.num_rows:
            here = [_read_run(x.as_py()) for x in batch.column("blob") if x.is_valid]
            keys, checks, docs, new = _merge(here) if here else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool))
            starts = np.flatnonzero(new)
            own, size = docs[starts], np.diff(np.concatenate((starts, [len(docs)])))
            least = own
            for x in history.column("run"):
                least = _least_of_history(least, keys[starts], checks[starts], _read_run(x.as_py()))
            fresh = starts[own <= least]
            mine = _run_blob(keys[fresh], checks[fresh], docs[fresh])
            late = docs > np.repeat(least, size)
            known = [(keys[late], checks[late], docs[late]), *(_read_run(x.as_py()) for x in batch.column("late") if x.is_valid)]
            keys, checks, docs = (np.concatenate(x) for x in zip(*known, strict=True))
            order = np.lexsort((keys, g := at.group_of(docs, groups)))
            g, keys, checks, docs = g[order], keys[order], checks[order], docs[order]
            cuts = at.bounds(g) if len(g) else [0]
            names = at.range_keys(groups)
            answers = [{"g": int(names[g[a]]), "blob": _run_blob(keys[a:b], checks[a:b], docs[a:b])} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kind = pa.list_(pa.struct([("g", pa.int64()), ("blob", pa.binary())]))
        rows = [[key[0].as_py()], [mine], [answers]] if mine else [[], [], []]
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], kind)], names=["key", "run", "answers"])

    return run


def _compact(key: tuple, table: pa.Table) -> pa.Table:
    """One run with the least document of each fingerprint."""
    keys, checks, docs, new = _merge([_read_run(x.as_py()) for x in table.column("run")])
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([_run_blob(keys[new], checks[new], docs[new])], pa.binary())], names=["key", "run"])


REMOVED = "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>"


def _judged(ids: np.ndarray, texts: pa.Array, marks: np.ndarray, k: int, digest: bool) -> tuple[list, ...]:
    """Columns of REMOVED but the first: word ranges that marked windows cover, and what is kept (or its SHA-256)."""
    first, second = at.WordHash(11), at.WordHash(12)
    raw_all, off_all = at.utf8(texts)
    out: tuple[list, ...] = ([], [], [], [])
    marked = np.zeros(1 << MARK_BITS, bool)  # most windows aren't among the marks and are done here
    marked[marks >> U(64 - MARK_BITS)] = True
    for a, b in at.slices(off_all):
        raw, off = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
        starts, ends, rows, own, keys, checks = _fingerprints(raw, off, first, second, k)
        covered = np.zeros(len(starts) + 1, np.int64)
        if len(own) and len(marks):
            mine = at.mix(keys ^ at.mix(checks ^ at.mix(ids[a:b][rows[own]].view(U))))
            some = np.flatnonzero(marked[mine >> U(64 - MARK_BITS)])
            own, mine = own[some], mine[some]
            where = np.searchsorted(marks, mine)
            where[where == len(marks)] = 0
            hit = own[marks[where] == mine]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + k, -1)
        gone = np.cumsum(covered)[:-1] > 0
        n = np.bincount(rows, minlength=b - a)
        lost = np.bincount(rows[gone], minlength=b - a)
        at_word = np.concatenate(([0], np.cumsum(n)))
        data = raw.tobytes()
        for i in range(b - a):
            lo, hi = at_word[i], at_word[i + 1]
            if lost[i]:
                keep = lo + np.flatnonzero(~gone[lo:hi])
                left = b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[lo:hi].view(np.int8), [0]))))
                out[3].append(edge.reshape(-1, 2).tolist())
            else:
                left = b" ".join(data[off[i] : off[i + 1]].split())
                out[3].append([])
            out[2].append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"))
        out[0].extend(n.tolist())
        out[1].extend(lost.tolist())
    return out


def _result(ids: pa.Array, columns: tuple[list, ...]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
    return [ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]


_NAMES = ["doc_id", "n_words", "n_removed", "kept", "removed"]


def _remove(k: int, digest: bool):
    """A group of documents and their repeated fingerprints."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        runs = [_read_run(x.as_py()) for x in found.column("blob")]
        marks = np.zeros(0, U)
        if runs:
            keys, checks, owners = (np.concatenate(x) for x in zip(*runs, strict=True))
            marks = np.unique(at.mix(keys ^ at.mix(checks ^ at.mix(owners.view(U)))))
        ids = docs.column("doc_id").combine_chunks().cast(pa.int64())
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
        open_ = zstandard.ZstdDecompressor().decompress
        texts = pa.array([open_(x) if x else b"" for x in docs.column("packed").to_pylist()], pa.large_binary())
        return pa.table(_result(ids, _judged(ids.to_numpy(zero_copy_only=False), texts, marks, k, digest)), names=_NAMES)

    return run


def _alone(k: int, digest: bool):
    """Rows without an id: nothing is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_result(batch.column(0), _judged(np.zeros(batch.num_rows, np.int64), at.strings(batch.column(1)), np.zeros(0, U), k, digest)), names=_NAMES)

    return run


def _dealt(groups: int):
    """Documents with their group, texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [x.as_py() for x in batch.column(1).cast(pa.large_binary())]
            packed = [None if x is None else squeeze(x) if x else b"" for x in packed]
            g = at.range_keys(groups)[at.group_of(batch.column(0).to_numpy(zero_copy_only=False), groups)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), batch.column(0), pa.array(packed, pa.binary())], names=["key", "doc_id", "packed"])

    return run


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class FingerprintIndex:
    """Runs of all earlier batches, by hash range, in a folder: a bucketed Parquet table with a partition for each run.

    A range must fit a task with its history: choose ``ranges`` for the size that the index shall grow to (default:
    by the first batch).  A batch under a name that was ingested before gets the same answers and adds nothing,
    as long as its run isn't compacted; a second writer gets a conflict.  Old runs go only after the manifest that replaces them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, ranges: int | None = None, fanout: int = 4) -> None:
        self.spark = spark
        self.folder = Folder(spark, path or Workspace(spark, "fingerprints").root)
        self.manifest = Manifest(self.folder)
        self._new = {"window": window, "ranges": ranges, "fanout": fanout, "next": 0, "levels": [], "batches": {}}

    @property
    def content(self) -> dict:
        return self.manifest.read() or self._new

    @property
    def levels(self) -> list[list[str]]:
        return self.content["levels"]

    def _table(self, ranges: int) -> str:
        """The table of all runs, a partition each, with a bucket for each range; known to this session from its first use."""
        name = f"fingerprints_{hashlib.sha256(self.folder.path.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(name):
            self.folder.make("runs")
            self.spark.sql(f"CREATE TABLE {name} (key BIGINT, run BINARY, answers ARRAY<STRUCT<g: BIGINT, blob: BINARY>>, name STRING) USING parquet "
                           f"PARTITIONED BY (name) CLUSTERED BY (key) INTO {ranges} BUCKETS LOCATION '{self.folder.path}/runs'")  # fmt: skip
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _write(self, df: DataFrame, name: str, ranges: int) -> None:
        self._drop(name, ranges)  # what a lost attempt may have left
        with shuffles_end_with_the_job(self.spark):
            df.withColumn("name", F.lit(name)).write.format("parquet").partitionBy("name").bucketBy(ranges, "key").mode("append").saveAsTable(self._table(ranges))

    def _drop(self, name: str, ranges: int) -> None:
        self.spark.sql(f"ALTER TABLE {self._table(ranges)} DROP IF EXISTS PARTITION (name = '{name}')")
        self.folder.delete(f"runs/name={name}")

    def _read(self, names: list[str], ranges: int) -> DataFrame:
        return self.spark.table(self._table(ranges)).where(F.col("name").isin(names))

    def history(self) -> DataFrame:
        """(key, run) of all live runs, in their buckets."""
        content = self.content
        live = [n for level in content["levels"] for n in level]
        return self._read(live, content["ranges"]).select("key", "run") if live else self.spark.createDataFrame([], "key long, run binary")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, batch: str | None = None) -> DataFrame:
        """REMOVED for each row of a batch, whose fingerprints join the index."""
        content, picked, groups = self.content, _picked(docs, id_col, text_col), groups_for(docs, text_col)
        ranges = content["ranges"] = content["ranges"] or 2 * groups
        name = content["batches"].get(batch) if batch is not None else None
        if name is None:
            name = f"run_{content['next']:06d}"
            runs = picked.mapInArrow(_runs(ranges, content["window"]), KEYED)
            self._write(runs.repartition(ranges, "key").groupBy("key").cogroup(self.history().groupBy("key")).applyInArrow(_ingest(groups), RUN), name, ranges)
            content["next"] += 1
            content["levels"] = [[*content["levels"][0], name], *content["levels"][1:]] if content["levels"] else [[name]]
            content["batches"] = content["batches"] | {batch or name: name}
            content = self.manifest.commit(content | {f"groups-{name}": groups})
        elif not any(name in level for level in content["levels"]):
            raise ValueError(f"the answers to batch {batch} are gone: its run is compacted")
        groups = content[f"groups-{name}"]
        answers = self._read([name], ranges).select(F.inline("answers")).toDF("key", "blob")
        dealt = picked.where("doc_id is not null").mapInArrow(_dealt(groups), "key long, doc_id long, packed binary")
        found = dealt.repartition(groups, "key").groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(_remove(content["window"], digest), REMOVED)
        alone = picked.where("doc_id is null").mapInArrow(_alone(content["window"], digest), REMOVED)
        return found.unionByName(alone)

    def compact(self) -> None:
        """Merge full levels; answers of their batches must have been taken."""
        content, level = self.content, 0
        while level < len(content["levels"]):
            old = content["levels"][level]
            if len(old) >= content["fanout"]:
                every = self._read(old, content["ranges"]).select("key", "run")
                name = f"run_{content['next']:06d}"
                merged = every.groupBy("key").applyInArrow(_compact, "key long, run binary").withColumn("answers", F.lit(None).cast("array<struct<g: bigint, blob: binary>>"))
                self._write(merged, name, content["ranges"])
                levels = [*content["levels"], []] if level + 1 == len(content["levels"]) else list(content["levels"])
                levels[level], levels[level + 1] = [], [*levels[level + 1], name]
                content = self.manifest.commit(content | {"levels": levels, "next": content["next"] + 1})
                for n in old:
                    self._drop(n, content["ranges"])
            level += 1


#: Batches that :func:`dedup` deals a table to, in ascending order of doc_id: shuffle files of one at a time are on disk.
BATCHES = 2


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, batches: int = BATCHES) -> DataFrame:
    """REMOVED for each row: kept words joined by one space (their SHA-256 with ``digest``), removed word ranges.

    Batches go through a new index.  Their doc_ids ascend, so each is judged by all smaller ids.
    """
    index, out, low = FingerprintIndex(docs.sparkSession, window=window), None, None
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [n / batches for n in range(1, batches)])).first()[0] if batches > 1 else []
    for high in [*sorted(set(cuts or [])), None]:
        part = docs if low is None else docs.where(F.col(id_col) > low)
        if high is not None:  # rows without an id go with the first
            part = part.where((F.col(id_col) <= high) | F.col(id_col).isNull() if low is None else F.col(id_col) <= high)
        found, low = index.ingest(part, id_col, text_col, digest), high
        out = found if out is None else out.unionByName(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM g JOIN f USING (s) WHERE least < doc_id),
rr AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY 1),
k AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN rr USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
