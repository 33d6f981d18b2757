"""Tables written between the steps of an iterative operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """``save`` writes a table under ``spark.checkpoint.dir`` and rereads it, which cuts the lineage.

    Where that setting is missing a private folder is made and set in local mode; on a cluster it is an error,
    as executors would not share it. Files go with ``clear``, at the latest when the driver ends: a returned
    DataFrame may still read them.
    """

    _open: list[Staging] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            if held.isEmpty():
                if not spark.sparkContext.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
                held = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = held.get()
        self.root = f"{base}/{label}-{uuid.uuid4().hex[:12]}"
        Staging._open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    @atexit.register
    def _close() -> None:
        for staging in Staging._open:
            try:
                if staging.spark.sparkContext._jsc is not None:
                    staging.clear()
            except Exception:  # noqa: BLE001, S110  the session may be gone already
                pass
