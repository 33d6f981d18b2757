"""Edges of one relationship kept for walks: twice, bucketed and sorted by each end, so that a level exchanges its frontier only.

Nodes with very many edges (at most 1000 of an end) would fill a bucket by themselves; their edges lie in a table
apart, in files of any number, and meet the few of them that a frontier holds by broadcast.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..sources.staging import Staging

#: Edges of a bucket, and most buckets: beyond that buckets grow.
BUCKET_EDGES, MOST_BUCKETS = 2_000_000, 8192
#: A node is a hub if it has so many edges and a thousandth of all.
HUB_EDGES, HUB_SHARE = 100_000, 1000
#: Frontiers that are written into the plan, so that buckets and row groups without their ids are not read, and that are broadcast.
MAX_LITERALS, MAX_BROADCAST = 1000, 20_000
ENDS = ("from_id", "to_id")
SCHEMA = "from_id string, to_id string"


@dataclass(frozen=True)
class Adjacency:
    """Distinct edges under one root; made by ``build``, found again by ``open``."""

    sparkSession: SparkSession  # noqa: N815  stands where a table of edges may stand
    root: str
    buckets: int
    hubs: dict[str, int]

    @staticmethod
    def build(edges: DataFrame, root: str, relationship: str = "calls") -> Adjacency:
        """Keep the relationship's edges under ``root``, where nothing may stand; rows without both ends are left out."""
        spark, root = edges.sparkSession, root.rstrip("/")
        staging = Staging(spark, "adjacency")
        pairs = staging.save(edges.filter(F.col("relationship") == relationship).select(*ENDS).dropna().distinct(), "pairs")
        n = pairs.count()
        buckets, hubs = min(MOST_BUCKETS, max(1, -(-n // BUCKET_EDGES))), {}
        for end in ENDS:
            counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= HUB_EDGES) & (F.col("n") * HUB_SHARE >= n))
            ids = staging.save(counts.select(end), f"hubs-{end}")
            hubs[end] = ids.count()  # at most HUB_SHARE, each has that part of all
            ids.write.parquet(f"{root}/hubs-{end}")
            light = pairs.join(F.broadcast(ids), end, "left_anti").select(*ENDS)
            light.repartition(buckets, end).write.bucketBy(buckets, end).sortBy(end).option(f"parquet.bloom.filter.enabled#{end}", "true").option("path", f"{root}/light-{end}").saveAsTable(_name(root, end))
            heavy = pairs.join(F.broadcast(ids), end, "left_semi").select(*ENDS)
            heavy.repartitionByRange(*((end, *(e for e in ENDS if e != end)))).write.parquet(f"{root}/heavy-{end}")
        Catalog(spark, root)._write_text(f"{root}/adjacency.json", json.dumps({"buckets": buckets, "hubs": hubs}))
        return Adjacency(spark, root, buckets, hubs)

    @staticmethod
    def open(spark: SparkSession, root: str) -> Adjacency:
        """What ``build`` finished under ``root``, in this session or another; an error if there is none."""
        root = root.rstrip("/")
        told = Catalog(spark, root)._read_text(f"{root}/adjacency.json")
        if told is None:
            raise FileNotFoundError(f"no adjacency under {root}")
        made = json.loads(told)
        for end in ENDS:
            spark.sql(f"create table if not exists {_name(root, end)} ({SCHEMA}) using parquet clustered by ({end}) sorted by ({end}) into {made['buckets']} buckets location '{root}/light-{end}'")
        return Adjacency(spark, root, made["buckets"], made["hubs"])

    def close(self) -> None:
        """Take the tables' names out of the session; the files stay."""
        for end in ENDS:
            self.sparkSession.sql(f"drop table if exists {_name(self.root, end)}")

    def touching(self, frontier: DataFrame, end: str, n: int) -> DataFrame:
        """Distinct edges whose ``end`` is in the frontier (a column of that name, at most ``n`` rows); no edge is exchanged."""
        spark, light = self.sparkSession, self.sparkSession.table(_name(self.root, end)).select(*ENDS)
        if n <= MAX_LITERALS:
            ids = sorted({r[0] for r in frontier.select(end).collect()} - {None})
            found = light.filter(F.col(end).isin(*ids)) if ids else light.filter("false")
        elif n <= MAX_BROADCAST:
            found = light.join(F.broadcast(frontier.select(end)), end, "left_semi").select(*ENDS)
        else:
            found = light.hint("merge").join(frontier.select(end).repartition(self.buckets, end), end, "left_semi").select(*ENDS)
        if not self.hubs[end]:
            return found
        met = spark.read.schema(f"{end} string").parquet(f"{self.root}/hubs-{end}").join(frontier.select(end), end, "left_semi")
        heavy = spark.read.schema(SCHEMA).parquet(f"{self.root}/heavy-{end}")
        return found.unionByName(heavy.join(F.broadcast(met), end, "left_semi").select(*ENDS))


def _name(root: str, end: str) -> str:
    return f"weft_{end}_{hashlib.sha256(root.encode()).hexdigest()[:24]}"
