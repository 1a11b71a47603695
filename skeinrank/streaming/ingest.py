"""Incremental indexing: immutable segments, deletion vectors, tiered compaction, and a Structured Streaming sink.

A store is a folder of segments and deletion vectors (tables of doc_ids) and a manifest that says which segments are live and
which vectors hold for each.  Every change is one new manifest, so an upsert (a vector for the old rows and a segment
with the new) is there whole or not at all, and readers see the old set or the new one.  Of two writers that commit at
once the later one applies its change to the other's result.  A batch is known by its source and number: a repeated one changes
nothing.  When a level holds ``per_level`` segments they are merged into one of the next level, without deleted rows.  Scores
don't depend on how rows are split into segments.

Folders that no manifest needs any more stay for ``grace`` seconds, for readers that still hold them.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, build
from ..sources.manifest import Conflict, Folder, Manifest
from ..types import IndexSpec

PER_LEVEL = 8

#: Seconds that retired folders stay; also the longest that a writer may take from its first file to its commit.
GRACE = 86_400.0


def with_number(ranges: list[list[int]], k: int) -> list[list[int]]:
    """Sorted disjoint ranges [first, last] of integers, and k; neighbours join, so consecutive batches are one range."""
    out: list[list[int]] = []
    for a, b in sorted([*ranges, [k, k]]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec | None = None, per_level: int = PER_LEVEL, grace: float = GRACE) -> None:
        if per_level < 2:
            raise ValueError("per_level must be 2 or more")
        self.spark, self.path, self.per_level, self.grace = spark, path.rstrip("/"), per_level, grace
        self._folder = Folder(spark, self.path)
        self._manifest = Manifest(self._folder)
        content = self._manifest.read()
        if content is None:
            if spec is None:
                raise ValueError(f"no segment store at {path}: give a specification")
            self._folder.make("manifests")
            try:
                content = self._manifest.commit({"spec": asdict(spec), "segments": [], "seen": {}, "retired": []})
            except Conflict:  # another writer has just made the store
                content = self._manifest.read()
        self.spec = IndexSpec(**content["spec"])

    @property
    def segments(self) -> list[dict]:
        """Live segments: name, level, docs (rows written, deleted ones included) and deletes (names of vectors)."""
        return self._manifest.read()["segments"]

    def _change(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Commits what ``change`` makes of the newest manifest, again after another writer's; None if it has nothing to change."""
        while True:
            content = change(self._manifest.read())
            if content is None:
                return None
            try:
                return self._manifest.commit(content)
            except Conflict:
                continue

    def _seen(self, content: dict, source: str, batch_id: int | None) -> bool:
        return batch_id is not None and any(a <= batch_id <= b for a, b in content["seen"].get(source, []))

    def _known(self, source: str, batch_id: int | None) -> bool:
        known = self._seen(self._manifest.read(), source, batch_id)
        if known:
            warnings.warn(f"batch {batch_id} of source {source!r} is in the store already; nothing is changed", stacklevel=3)
        return known

    def append(self, df: DataFrame, batch_id: int | None = None, source: str = "") -> str | None:
        """One level-0 segment from a batch of documents; None (and no segment) if none has a term or the batch is there already.

        ``batch_id`` None is always a new batch.  Rows that repeat a doc_id are rows of their own.
        """
        return None if self._known(source, batch_id) else self._add(df, batch_id, source, None)

    def upsert(self, df: DataFrame, batch_id: int | None = None, source: str = "") -> str | None:
        """Replaces documents in one change: their old rows leave every segment and the new ones are a segment.

        A document whose new text has no term is deleted.  A repeated batch neither deletes nor adds.
        """
        if self._known(source, batch_id):
            return None
        return self._add(df, batch_id, source, self._vector(df.select(F.col(self.spec.id_column).alias("doc_id"))))

    def delete(self, ids: DataFrame) -> None:
        """Removes documents (doc_id) and their part in the statistics, by a vector beside the segments.  To keep
        statistics as they were, leave the store alone and search with ``live=``."""
        vector = self._vector(ids.select("doc_id"))
        if vector:
            self._change(lambda content: self._with_vector(content, vector))
            self.compact()

    def _add(self, df: DataFrame, batch_id: int | None, source: str, vector: str | None) -> str | None:
        name = uuid.uuid4().hex
        count = self._save(build(df, self.spec), name)

        def change(content: dict) -> dict | None:
            if self._seen(content, source, batch_id):  # by another writer meanwhile
                return None
            if vector:
                content = self._with_vector(content, vector)
            if batch_id is not None:
                content["seen"][source] = with_number(content["seen"].get(source, []), batch_id)
            if count:
                content["segments"].append({"name": name, "level": 0, "docs": count, "deletes": []})
            return content

        done = self._change(change)
        self.compact()
        return name if done and count else None

    def _vector(self, ids: DataFrame) -> str | None:
        """The name of a written table of doc_ids; None if there are none."""
        name = uuid.uuid4().hex
        ids.where("doc_id is not null").distinct().write.parquet(f"{self.path}/deletes/{name}")
        return None if self.spark.read.parquet(f"{self.path}/deletes/{name}").isEmpty() else name

    @staticmethod
    def _with_vector(content: dict, vector: str) -> dict:
        return content | {"segments": [s | {"deletes": [*s["deletes"], vector]} for s in content["segments"]]}

    def _save(self, index: Index, name: str) -> int:
        """Writes a segment and returns its documents."""
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        folder = f"{self.path}/segments/{name}"
        index.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
        index.doc_stats.write.parquet(f"{folder}/doc_stats")
        return self.spark.read.parquet(f"{folder}/doc_stats").count()

    def _merged(self, segments: list[dict]) -> Index:
        """Segments as one index without deleted rows; those that share their vectors are read together."""
        groups: dict[tuple[str, ...], list[str]] = {}
        for s in segments:
            groups.setdefault(tuple(s["deletes"]), []).append(s["name"])

        def table(kind: str) -> DataFrame:
            parts = []
            for vectors, names in groups.items():
                rows = self.spark.read.parquet(*(f"{self.path}/segments/{n}/{kind}" for n in names))
                if vectors:
                    gone = self.spark.read.parquet(*(f"{self.path}/deletes/{v}" for v in vectors)).distinct()
                    rows = rows.join(gone, "doc_id", "left_anti")
                parts.append(rows)
            return reduce(DataFrame.unionByName, parts)

        return Index(self.spec, table("postings"), table("doc_stats"))

    def compact(self, everything: bool = False) -> list[str]:
        """Merges full levels (or all segments), and rewrites segments with more than ``per_level`` vectors; the new segments' names."""
        made = []
        while True:
            segments = self.segments
            old = self._due(segments, everything)
            if not old:
                break
            name = uuid.uuid4().hex
            count = self._save(self._merged(old), name)
            level = max(s["level"] for s in old) + (len(old) > 1)

            def change(content: dict, old=old, name=name, count=count, level=level) -> dict | None:
                if any(s not in content["segments"] for s in old):  # deletes or a merge came between: what was written is stale
                    return None
                rest = [s for s in content["segments"] if s not in old]
                still = {v for s in rest for v in s["deletes"]}
                gone = [f"segments/{s['name']}" for s in old] + sorted({f"deletes/{v}" for s in old for v in s["deletes"] if v not in still})
                new = [{"name": name, "level": level, "docs": count, "deletes": []}] if count else []
                return content | {"segments": rest + new, "retired": content["retired"] + [{"name": x, "at": time.time()} for x in gone]}

            if self._change(change) is not None and count:
                made.append(name)
            if everything:
                break
        self.vacuum()
        return made

    def _due(self, segments: list[dict], everything: bool) -> list[dict] | None:
        if everything:
            return segments if len(segments) > 1 or any(s["deletes"] for s in segments) else None
        levels: dict[int, list[dict]] = {}
        for s in segments:
            levels.setdefault(s["level"], []).append(s)
        full = next((x for _, x in sorted(levels.items()) if len(x) >= self.per_level), None)
        return full or next(([s] for s in segments if len(s["deletes"]) > self.per_level), None)

    def vacuum(self) -> list[str]:
        """Removes folders retired, or left by a failed writer, more than ``grace`` seconds ago; their names."""
        before = time.time() - self.grace
        content = self._manifest.read()
        named = {f"segments/{s['name']}" for s in content["segments"]} | {f"deletes/{v}" for s in content["segments"] for v in s["deletes"]} | {r["name"] for r in content["retired"]}
        found = [f"{kind}/{n}" for kind in ("segments", "deletes") for n in self._folder.names(kind)]
        gone = [r["name"] for r in content["retired"] if r["at"] <= before] + [n for n in found if n not in named and self._folder.modified(n) <= before]
        for name in gone:
            self._folder.delete(name)
        if any(r["name"] in gone for r in content["retired"]):
            self._change(lambda c: c | {"retired": [r for r in c["retired"] if r["name"] not in gone]})
        self._manifest.prune()
        return gone

    def index(self) -> Index:
        """All live segments as one index."""
        segments = self.segments
        if not segments:
            empty = build(self.spark.createDataFrame([], f"{self.spec.id_column} long, {self.spec.column} string"), IndexSpec(self.spec.name, self.spec.column, self.spec.text_config or "simple", id_column=self.spec.id_column))
            return Index(self.spec, empty.postings, empty.doc_stats)
        return self._merged(segments)

    def stream(self, source: DataFrame, checkpoint: str, **trigger):
        """A running streaming query that appends every micro-batch; use availableNow=True to drain and stop.

        Batches are known by the id in the checkpoint, so several queries, or a new checkpoint, can feed one store.
        """
        folder = Folder(self.spark, checkpoint)

        def add(df: DataFrame, batch_id: int) -> None:
            self.append(df, batch_id, json.loads(folder.read("metadata"))["id"])

        return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
