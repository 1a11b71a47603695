"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input (as stored) that one group of an operator should hold, and above which a plan's size isn't believed.
GROUP_BYTES, UNKNOWN = 16_000_000, 1 << 55
#: Bytes of a batch that goes to a Python worker (a longer row is one of its own): the JVM and the worker hold two copies of it or more.
BATCH_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset in local mode, a temporary folder of this process.

    A cluster's executors don't see such a folder, so there the setting must be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_end_with_the_job(spark: SparkSession):
    """Shuffle files of a write go when it is done (what it wrote cuts the lineage), not when the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Batches to Python workers are bounded by bytes, not just by rows, in plans that run meanwhile."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Workspace:
    """Named Parquet tables of one operator run.  Written tables cut lineage and survive lost executors; they go with the session."""

    def __init__(self, spark: SparkSession, label: str, bounded: bool = False) -> None:
        """``bounded``: what is saved runs with :func:`small_batches`."""
        self.spark, self.bounded = spark, bounded
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        target = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with shuffles_end_with_the_job(self.spark), small_batches(self.spark) if self.bounded else contextlib.nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_skein_path", None)
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def groups_for(df: DataFrame, text_col: str, each: int = GROUP_BYTES) -> int:
    """How many groups a table should be dealt to: one for each ``each`` bytes, and one for each shuffle partition at least.

    The size is that of the files, as the plan knows it; of other inputs the texts' own bytes are summed.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:
        size = int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]) // 2
    return max(partitions(df.sparkSession), -(-size // each))
