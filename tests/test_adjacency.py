"""Kept edges: walks agree with walks over the plain table, levels exchange no edge, hubs lie apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import adjacency, graph
from weftgraph.operators.adjacency import Adjacency


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(5)
    rows = [(f"n{r.randrange(60)}", r.choice(["calls"] * 9 + ["handled_by"]), f"n{r.randrange(60)}") for _ in range(150)]
    rows += [("n1", "calls", f"leaf{i}") for i in range(80)] + [(f"root{i}", "calls", "n2") for i in range(80)]  # a hub of each end
    rows += [*rows[:40], (None, "calls", "n3"), ("n3", "calls", None)]
    return spark.createDataFrame(rows, "from_id string, relationship string, to_id string")


def edges_of(table):
    return sorted((r.from_id, r.to_id) for r in table.collect())


def told(walked):
    found, nodes, cut = walked
    return edges_of(found), sorted((r.id, r.depth) for r in nodes.collect()), cut


@pytest.mark.parametrize("literals, broadcast", [(1000, 20_000), (0, 20_000), (0, 0)], ids=["literals", "broadcast", "merge"])
def test_walks_agree(spark, tmp_path, monkeypatch, calls, literals, broadcast):
    for name, value in (("BUCKET_EDGES", 60), ("HUB_EDGES", 50), ("MAX_LITERALS", literals), ("MAX_BROADCAST", broadcast)):
        monkeypatch.setattr(adjacency, name, value)
    whole = calls.dropna()
    kept = Adjacency.build(calls, str(tmp_path / "kept"))
    assert kept.buckets > 2 and kept.hubs == {"from_id": 1, "to_id": 1}
    kept.close()
    kept = Adjacency.open(spark, str(tmp_path / "kept"))
    for ids, direction, depth, most in ((["n1"], "out", 3, 10**6), (["n2", "n7", "none"], "in", 2, 10**6), (["n4"], "out", 9, 25)):
        seeds = spark.createDataFrame([(i,) for i in ids], "id string")
        assert told(graph.walk(kept, seeds, direction, depth, most)) == told(graph.walk(whole, seeds, direction, depth, most))
    kept.close()


def test_levels_exchange_no_edge(spark, tmp_path, monkeypatch, calls):
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 60)
    monkeypatch.setattr(adjacency, "MAX_BROADCAST", 0)
    kept = Adjacency.build(calls, str(tmp_path / "kept"))
    ids = spark.createDataFrame([("n1",), ("n5",)], "from_id string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.touching(ids, "from_id", 10**6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Bucketed: true" in plan
    kept.close()


def test_small_frontiers_read_their_buckets_only(spark, tmp_path, monkeypatch, calls):
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 60)
    kept = Adjacency.build(calls, str(tmp_path / "kept"))
    ids = spark.createDataFrame([("n5",)], "from_id string")
    found = kept.touching(ids, "from_id", 1)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    used = {r[0].rsplit("/", 1)[-1] for r in found.select(F.input_file_name()).distinct().collect()}
    others = [f for f in (tmp_path / "kept" / "light-from_id").glob("*.parquet") if f.name not in used]
    assert len(used) == 1 and len(others) > 1
    for f in others:
        f.write_bytes(b"broken")
    assert edges_of(kept.touching(ids, "from_id", 1)) == edges_of(calls.dropna().filter("from_id = 'n5' and relationship = 'calls'").select("from_id", "to_id").distinct())
    kept.close()


def test_nothing_kept(spark, tmp_path, calls):
    with pytest.raises(FileNotFoundError):
        Adjacency.open(spark, str(tmp_path / "none"))
    kept = Adjacency.build(calls.limit(0), str(tmp_path / "empty"))
    assert told(graph.walk(kept, spark.createDataFrame([("n1",)], "id string"), "out", 2, 10)) == ([], [], False)
    kept.close()
