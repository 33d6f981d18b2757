"""Edges and counts of calls without a row per call and provider: the results of the joins that make those rows."""

from __future__ import annotations

import random

import pytest

from weftgraph.operators import resolve
from weftgraph.plans.catalogue import QUERIES

SEGMENTS = ("a", "b", "{id}", ":x", "c", "")


def _tables(spark, seed: int):
    dice = random.Random(seed)
    slugs = [*(f"s{i}" for i in range(14)), "s_1", "s-1x", "orders_api", "x.example"]
    path = lambda: dice.choice((None, "/", "/" + "/".join(dice.choices(SEGMENTS, k=dice.randint(1, 3)))))
    verb = lambda: dice.choice(("get", "GET", "post", None, ""))
    host = lambda: dice.choice((None, "", "s1", "s12", "orders-api.local", "s-1", "cdn.vendor.example", "S3.amazonaws.com", "a.x-example:80", *slugs))
    calls = [(s, k, verb(), path(), host()) for s in slugs[:9] for k in range(60)]
    offers = [(s, dice.choice(("rest", None, "event")), verb(), path(), "") for s in slugs for _ in range(9)]
    return (
        spark.createDataFrame(calls, "slug string, pos int, verb string, path string, host string"),
        spark.createDataFrame(offers, "slug string, type string, method string, path string, framework string"),
        spark.createDataFrame([(s,) for s in slugs if s != "x.example"], "slug string"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edges_and_counts_by_class(spark, monkeypatch, seed):
    """As the rows per call and provider say; chunks of two, no broadcast in every other run."""
    monkeypatch.setattr(resolve, "CHUNK", 2)
    if seed % 2:
        monkeypatch.setattr(resolve, "MAX_HOSTS", 0)
        monkeypatch.setattr(resolve, "MAX_PROVIDERS", 0)
    calls, offers, fleet = _tables(spark, seed)
    matched = resolve.match_calls(calls, offers, fleet)
    edges = lambda df: sorted((r.from_slug, r.to_slug, r.confidence, tuple(r.via_paths)) for r in df.collect())
    wanted = edges(resolve.call_edges(matched))
    assert edges(resolve.linked_calls(calls, offers, fleet)) == wanted and {w[2] for w in wanted} == {"high", "ambiguous", "corroborated"} or seed > 1
    counts = lambda df: sorted(map(tuple, df.collect()))
    assert counts(resolve.count_calls(calls, offers, fleet)) == counts(resolve.resolve_counters(matched))
    shapes = resolve._providers(calls.selectExpr("path", "upper(coalesce(verb, '')) as verb_"), offers).filter("size(_providers) > 0")
    met = calls.selectExpr("slug", "path", "upper(coalesce(verb, '')) as verb_").join(shapes, ["verb_", "path"]).select("slug").distinct()
    assert counts(resolve.callers_of(calls, offers)) == counts(met)


def test_no_service_is_numbered_in_one_task(spark):
    """Edges are dealt out in the number of tasks that the pairs ask for; calls are not numbered by a window per service."""
    from weftgraph.plans.views import load, placed

    assert "Window" in load(spark, "/root/testdata/sf0.001", "outbound")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in placed(spark, "/root/testdata/sf0.001", "outbound")._jdf.queryExecution().optimizedPlan().toString()
    plan = QUERIES["resolve_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
