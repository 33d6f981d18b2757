"""Days by the microsecond, chains by doubled pointers, texts searched where they lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import graph, semantic


def test_a_day_begins_with_its_first_microsecond(spark):
    rows = spark.createDataFrame([(0, "2024-01-11 00:00:00"), (1, "2024-01-11 00:00:00.000001"), (2, "2023-12-31 23:59:59.999999"), (3, "2024-01-01 00:00:00.5"), (4, None), (5, "2023-12-01 00:00:00.25")], "k int, t string")
    left = S.days_left(F.col("t").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    assert [r.d for r in rows.select("k", left.alias("d")).orderBy("k").collect()] == [10, 11, 0, 1, 0, 0]


def test_chains_by_doubled_pointers(spark):
    """Chains up to one alias more than the hops allowed; longer ones, cycles and what leads into them give null."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    rows = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "y"), ("self", "self"), ("n", None), ("lone", "end")], "name string, target string")
    for hops in (1, 6, 7, 8, 24):
        found = {r.name: r.declared for r in graph.resolve_aliases(rows, hops).collect()}
        assert found == {**{f"c{i}": "c40" if 40 - i <= hops + 1 else None for i in range(40)}, "x": None, "y": None, "z": None, "self": None, "n": None, "lone": "end"}


def test_a_chain_of_many_aliases_takes_few_joins(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(graph.Staging, "save", lambda self, df, name, f=graph.Staging.save: saved.append(df) or f(self, df, name))
    graph.resolve_aliases(spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(25)], "name string, target string"))
    assert len(saved) <= 7 and not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in saved)


def test_texts_are_not_dealt_out_by_repository(spark, monkeypatch):
    """No exchange of the texts by repository alone; many repositories, without the broadcast, find the same."""
    texts = spark.createDataFrame([(f"r{i % 3}", f"say('v{i}') or \"w{i}\"") for i in range(30)], "slug string, text string")
    asked = spark.createDataFrame([(f"r{r}", f"{w}{i}") for r in range(3) for i in range(30) for w in "vwx"], "slug string, value string")
    wanted = sorted((f"r{i % 3}", f"{w}{i}") for i in range(30) for w in "vw")
    found = semantic.grounded(asked, texts)
    assert sorted(map(tuple, found.collect())) == wanted
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [slug" in plan
    monkeypatch.setattr(semantic, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, semantic.grounded(asked, texts).collect())) == wanted
