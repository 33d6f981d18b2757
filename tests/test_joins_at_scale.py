"""Joins whose work must stay in proportion: templates by masks, spans by tiles, channels by cells; each against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftgraph.operators import intervals, resolve


def matches(call, offer):
    a, b = ([s for s in p.split("/") if s] for p in (call, offer))
    wild = lambda s: s.startswith(("{", ":", "<"))
    return len(a) == len(b) and all(wild(y) or (x == y and not wild(x)) for x, y in zip(a, b)) and any(not wild(x) for x in a)


def test_templates_against_brute_force(spark):
    r = random.Random(1)
    path = lambda: "/" + "/".join(r.choice(("a", "b", "c", "{x}", ":y", "*")) for _ in range(r.randrange(0, 4)))
    offers = [(f"s{i % 7}", "rest", r.choice(("GET", "post", None)), path(), "") for i in range(120)]
    calls = [(f"s{i % 9}", i, r.choice(("get", "POST", None)), path(), None) for i in range(150)]
    out = resolve.match_calls(
        spark.createDataFrame(calls, "slug string, pos int, verb string, path string, host string"), spark.createDataFrame(offers, "slug string, type string, method string, path string, framework string"),
        spark.createDataFrame([(f"s{i}",) for i in range(9)], "slug string")).collect()
    got = {}
    for x in out:
        got.setdefault(x.pos, set()).add(x.provider)
    for slug, pos, verb, p, _ in calls:
        want = {s for s, _, m, o, _ in offers if (m or "").upper() == (verb or "").upper() and s != slug and matches(p, o)}
        assert got[pos] == (want or {None}), (p, verb)


def test_templates_meet_by_equality_alone(spark):
    """Of 20,000 shapes and 20,000 patterns of one verb and length no more rows are made than shapes times masks."""
    calls = spark.range(20_000).select(F.lit("c").alias("slug"), F.col("id").alias("pos"), F.lit("get").alias("verb"), F.concat(F.lit("/x/"), "id", F.lit("/y")).alias("path"), F.lit(None).cast("string").alias("host"))
    offers = spark.range(20_000).select(F.concat(F.lit("p"), F.col("id") % 50).alias("slug"), F.lit("rest").alias("type"), F.lit("GET").alias("method"), F.concat(F.lit("/x/"), "id", F.when(F.col("id") % 2 == 0, "/y").otherwise("/{z}")).alias("path"), F.lit("").alias("framework"))
    matched = resolve.match_calls(calls, offers, spark.createDataFrame([("c",)], "slug string"))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "forall" not in plan
    assert matched.filter("status = 'resolved'").count() == 20_000


def test_tiles(spark):
    r = random.Random(2)
    spans = [(a, a + r.choice((0, 1, 5, 200, 70_000))) for a in (r.randrange(0, 3_000) for _ in range(60))] + [(0, 10**8), (1, 10**8 - 1)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("n")).collect()
    for x in rows:
        parts = sorted((n["at"] << n["level"], (n["at"] + 1 << n["level"]) - 1) for n in x.n)
        assert parts[0][0] == x.a and parts[-1][1] == x.b and all(p[1] + 1 == q[0] for p, q in zip(parts, parts[1:])) and len(parts) <= 54


def test_spans_against_brute_force(spark):
    r = random.Random(3)
    spans = [(f"f{i % 3}", a, a + r.choice((0, 3, 60, 64, 500, 9_000_000)), f"s{i:03}") for i in range(150) for a in [r.randrange(0, 900)]]
    points = [(f"f{r.randrange(4)}", r.randrange(0, 1200)) for _ in range(200)]
    s, p = spark.createDataFrame(spans, "path string, start long, end long, id string"), spark.createDataFrame(points, "path string, line long")
    found = {(x.path, x.line): x.id for x in intervals.tightest_span(p, s).collect()}
    for path, line in points:
        fit = [(b - a, -a, i) for q, a, b, i in spans if q == path and a <= line <= b]
        best = min(((size, start) for size, start, _ in fit), default=None)
        assert found[path, line] == (max(i for size, start, i in fit if (size, start) == best) if fit else None)
    evidence = [(f"e{i}", f"f{r.randrange(3)}" + (f":{a}-{a + r.choice((0, 2, 100, 5000))}" if i % 5 else "")) for i in range(80) for a in [r.randrange(1, 1000)]]
    got = {(x.ref, x.id) for x in intervals.evidence_symbols(spark.createDataFrame(evidence, "ref string, e string"), s).collect()}
    want = set()
    for ref, e in evidence:
        path, _, at = e.partition(":")
        lo, hi = map(int, at.split("-")) if at else (0, 10**9)
        want |= {(ref, i) for q, a, b, i in spans if q == path and not (hi < a or lo > b)}
    assert got == want and len(got) > 500


def test_channels_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    ends = [(f"s{r.randrange(60)}", r.choice(("hot", "hot", "a", "b", "quiet")), r.choice(("PUBLISH", "CONSUME", "USES")), r.choice(("config", "messaging"))) for _ in range(600)]
    ends = [(s, c, "USES" if c == "quiet" else d, f) for s, c, d, f in ends]
    table = spark.createDataFrame(ends, "slug string, channel string, direction string, framework string")
    pubs, cons = {(c, s) for s, c, d, _ in ends if d == "PUBLISH"}, {(c, s) for s, c, d, _ in ends if d != "PUBLISH"}
    config = {(c, s, d == "PUBLISH") for s, c, d, f in ends if f == "config"}
    want = {}
    for c, a in pubs:
        for k, b in cons:
            if c == k and a != b:
                e = want.setdefault((a, b), [set(), False])
                e[0].add(c)
                e[1] |= (c, a, True) in config or (c, b, False) in config
    quiet = {(a, b): ["quiet"] for c, a in cons for k, b in cons if c == k == "quiet" and a < b}
    for cell in (256, 4):
        monkeypatch.setattr(resolve, "CELL", cell)
        assert {(x.from_slug, x.to_slug): [set(x.channels), x.confidence == "config"] for x in resolve.publish_edges(table).collect()} == want
        assert {(x.from_slug, x.to_slug): x.channels for x in resolve.shared_edges(table).collect()} == quiet


def test_a_hot_channel_is_many_cells(spark):
    """5,000 ends of one channel: no cell holds more than its share of the pairs."""
    ends = spark.range(5_000).select(F.concat(F.lit("s"), "id").alias("slug"), F.lit("hot").alias("channel"))
    a, b = resolve._cells(ends.filter("hash(slug) % 2 = 0"), ends)
    sizes = a.groupBy("_i", "_j").count().withColumnRenamed("count", "l").join(b.groupBy("_i", "_j").count().withColumnRenamed("count", "r"), ["_i", "_j"]).selectExpr("l * r as pairs").collect()
    pairs = [x.pairs for x in sizes]
    assert len(pairs) >= 100 and max(pairs) <= 2 * sorted(pairs)[len(pairs) // 2]
