"""Shared plumbing of the training-data operators: staged tables, gapless ranks, skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space of the word contracts, as the inside of a regex class.
SPACE = r"\x20\x09-\x0D"
#: Rows of one rank bin, so that a group of any size is numbered by many tasks.
BIN_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a private one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weft-")
        context.setCheckpointDir(found)
        found = context._jsc.sc().getCheckpointDir().get()
    return found


class Workspace:
    """Tables written to the shared folder to cut lineage; they outlive any executor.

    ``save`` writes and rereads, ``drop`` deletes one that no later plan reads. What is left (a returned
    DataFrame may still read it) goes when the driver process ends.
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        Workspace._open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    @staticmethod
    @atexit.register
    def _close() -> None:
        for space in Workspace._open:
            try:
                if space.spark.sparkContext._jsc is not None:
                    space.drop()
            except Exception:  # noqa: BLE001, S110  the session may be gone already
                pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that are no longer referenced."""
    import gc
    import time

    for _ in range(2):  # the gateway lets go of Python's references a moment after they are gone
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


#: Most bytes of an Arrow batch. One bound for all stages, as a plan reads it when it runs, not when it is made.
BATCH_BYTES = 8 << 20


def python_stage(spark: SparkSession) -> None:
    """Before a stage in Python: ship the code, bound Arrow batches in bytes (a batch of very long texts must fit).

    The bound stays with the session; it is the same for every stage, and a smaller one of the session's own is left alone.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, typed null where the table has none; other columns cannot clash then."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(f"`{n}`") if n in docs.columns else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names))


def n_bins(rows: int, per_bin: int = BIN_ROWS) -> int:
    return max(1, -(-rows // per_bin))


def with_rank(df: DataFrame, group: str, order: list[Column], spread: list[Column], rows: int, name: str) -> DataFrame:
    """Number the rows of each group gaplessly from 0 as ``name``.

    A group is dealt to bins by the hash of ``spread``; bins are numbered in parallel and shifted by the
    sizes of the bins before them, so no task holds a whole group.
    """
    bins = n_bins(rows)
    at = df.withColumn("_bin", F.pmod(F.xxhash64(*spread), F.lit(bins)).cast("int"))
    inside = Window.partitionBy(group, "_bin").orderBy(*order)
    if bins == 1:
        return at.withColumn(name, F.row_number().over(inside).cast("long") - 1).drop("_bin")
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shift = at.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n")).select(group, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = at.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
    return ranked.join(shift, [group, "_bin"]).withColumn(name, F.col("_shift") + F.col("_r")).drop("_bin", "_shift", "_r")


def hot_keys(groups: DataFrame, count: str, rows: int, share: int = 1000) -> Column:
    """True for groups of at least ``rows / share`` rows: there are at most ``share`` of them."""
    return F.col(count) * share >= F.lit(max(rows, share))


def skew_safe_join(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per (non-null) key, whatever the largest key's share.

    The at most 1000 groups that hold a thousandth of all rows each are broadcast (a proven bound); rows of
    all other groups are joined by key.
    """
    hot = F.broadcast(groups.filter(hot_keys(groups, count, total)))
    near = rows.join(hot, key)
    far = rows.join(hot.select(key), key, "left_anti").join(groups.filter(~hot_keys(groups, count, total)), key)
    return near.unionByName(far)
