"""Rules and services met by class, lines of a file taken together."""

from __future__ import annotations

import random

import pytest

from weftgraph.operators import intervals, rules
from weftgraph.plans.catalogue import QUERIES


@pytest.mark.parametrize("chunk", [2, 1000])
def test_rules_by_class(spark, monkeypatch, chunk):
    """As every pair says; no pair is dealt out or made distinct."""
    monkeypatch.setattr(rules, "CHUNK", chunk)
    dice = random.Random(chunk)
    some = lambda words: dice.choice((None, [], dice.choices(words, k=dice.randint(1, 3))))
    held = [(f"r{i}", some(["A", "b", "C", "d"]), some(["x", "Y", "z"])) for i in range(40)]
    services = [(f"s{i}", some(["a", "B", "c"]), some(["X", "y"]), dice.choice(("auto", "", None, "Z", "x"))) for i in range(40)]
    low = lambda v: {w.lower() for w in v or ()}
    wanted = []
    for s, d, seen, lang in services:
        own = low(seen) or ({lang.lower()} if lang not in ("auto", "", None) else set())
        for r, deps, langs in held:
            a, b = low(deps) & low(d), low(langs) & own
            if (not deps or a) and (not langs or b):
                wanted.append((s, r, (*sorted(a), *sorted(b))))
    links = rules.governed_by(spark.createDataFrame(held, "id string, dependencies array<string>, languages array<string>"), spark.createDataFrame(services, "id string, dependencies array<string>, languages array<string>, language string"))
    assert sorted((x.service, x.rule, tuple(x.matched)) for x in links.collect()) == sorted(wanted)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_pairs_of_rules_are_handed_on_by_rule(spark):
    """What was matched is told before the pairs come out, and the pairs of two groups never lie in one task at once."""
    found = QUERIES["rules_overlap"](spark, "/root/testdata/sf0.001")
    steps = [line.split("[")[0].strip(" +-:").split(" ")[0] for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    steps = [s for s in steps if s in ("Generate", "Repartition")]
    assert steps == ["Generate", "Repartition", "Generate", "Repartition"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_join") > plan.rindex("Generate")


@pytest.mark.parametrize("tie", ["latest", "lowest"])
def test_lines_of_a_leaf_travel_as_one_row(spark, tie):
    """As every pair says, null and negative lines included; no line is entered by itself under a level."""
    points = spark.range(2000).selectExpr("concat('f', id % 7) as path", "cast(if(id % 50 = 3, null, id % 311 - 20) as int) as line", "id as k")
    spans = spark.range(500).selectExpr("concat('f', id % 9) as path", "cast(id % 200 - 10 as int) as start", "cast(id % 200 + (id % 5) * 37 as int) as end", "concat('s', id) as id")
    found = intervals.tightest_span(points, spans, tie)
    held = [tuple(r) for r in spans.collect()]

    def best(path, line):
        around = [(b - a, a, i) for f, a, b, i in held if line is not None and f == path and a <= line <= b]
        return (min((n, i) for n, _, i in around) if tie == "lowest" else max((-n, a, i) for n, a, i in around))[-1] if around else None

    assert sorted(map(tuple, found.select("k", "id").collect())) == [(r.k, best(r.path, r.line)) for r in points.orderBy("k").collect()]
    assert "collect_set(line" in found._jdf.queryExecution().optimizedPlan().toString()
