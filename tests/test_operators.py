from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import graph, intervals, lookup, quality, resolve, rules, semantic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (S.normalize_path, "/a/<int:id>/{b}/:c/", "/a/{}/{}/{}"), (S.normalize_path, "", "/"), (S.path_slug, "/events/{id:int}", "events-id"), (S.path_slug, "/", "root"),
    (S.strip_env_prefix, "stag-a-b", "a-b"), (S.strip_env_prefix, "a-b", "a-b"), (S.strip_env_prefix, "ab", "ab"), (S.slugish, "-Orders_Svc!", "orders-svc"),
    (S.bare_host, "http://u:p@Orders-svc:8080/v1?x", "orders-svc"), (S.bare_port, "http://h:8080/x", "8080"), (S.bare_port, "http://h:8/x", ""),
    (S.redact, "postgres://admin:pw@db:5432/o", "postgres://db:5432/o"), (S.redact, "A" * 30, "[redacted]"), (S.route_path, "app.orders.fetch", None), (S.route_path, "x", "/x"),
    (S.dependency_name, " GitHub.com/X/My_Lib ", "my-lib"), (S.dependency_name, "@s/A_b", "@s/a_b"), (S.url_requirement, "git+ssh://git@h/o/torpedo.git@3.7", "torpedo"),
    (S.singular, "companies", "company"), (S.singular, "orders", "order"), (S.singular, "class", "class"), (S.first_sentence, "One. Two.", "One."), (S.entity_norm, "service:My_Svc ", "my-svc"),
    (S.valid_alias, "a.b-1", True), (S.valid_alias, "-a", False),
])
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_more_scalars(spark):
    assert one(spark, S.path_pattern(F.lit("/a/{x}//:y/b"))) == ["a", None, None, "b"]
    assert tuple(one(spark, S.url_to_path(F.lit("https://h:1/x?q")))) == ("/x?q", "h:1") and tuple(one(spark, S.url_to_path(F.lit("/p")))) == ("/p", None)
    assert tuple(one(spark, S.parse_evidence(F.lit("a/b.py:3-9")))) == ("a/b.py", 3, 9) and one(spark, S.parse_evidence(F.lit(":x"))) is None
    assert one(spark, S.reversion(F.lit("/v4/m"), F.lit("/v5"))) == "/v5/m" and one(spark, S.reversion(F.lit("/m"), F.lit("/v5"))) == "/v5/m"
    assert one(spark, S.join_path(F.lit("/a/"), F.lit("/b"))) == "/a/b"
    assert one(spark, S.whole_sentences(F.lit("One two. Three four five six"), 15)) == "One two."
    assert one(spark, S.match_keys(F.lit("A.b"), F.lit("symbol"))) == ["a.b", "b"]
    assert tuple(one(spark, S.source_span(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(4), 0, 2))) == (2, "b\nc", True)
    assert one(spark, S.days_left(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-01 12:00").cast("timestamp"))) == 2


def test_template_rules(spark):
    """A provider template takes anything; a consumer template needs a provider template."""
    offered = spark.createDataFrame([("a", "rest", "GET", "/o/{id}", ""), ("b", "rest", "GET", "/o/new", ""), ("c", "rest", "GET", "/o/{id}", ""), ("a", "event", "GET", "/o/1", "")], "slug string, type string, method string, path string, framework string")
    calls = spark.createDataFrame([("x", 1, "get", "/o/new", None), ("x", 2, "GET", "/o/{}", "c_host"), ("a", 1, "GET", "/o/5", "s3.amazonaws.com"), ("a", 2, "GET", "/", None), ("a", 3, "GET", "/o/5", "a.internal.example"), ("z", 1, "PUT", "/o/5", None)],
                                  "slug string, pos int, verb string, path string, host string")
    services = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("z",)], "slug string")
    made = resolve.match_calls(calls, offered, spark.createDataFrame([("internal",), ("c",)], "slug string"))
    assert {(r.slug, r.pos, r.status, r.provider) for r in made.collect()} == {("x", 1, "resolved", "a"), ("x", 1, "resolved", "b"), ("x", 1, "resolved", "c"), ("x", 2, "resolved", "a"), ("x", 2, "resolved", "c"), ("a", 1, "resolved", "c"), ("a", 2, "unspecific", None), ("a", 3, "resolved", "c"), ("z", 1, "unresolved", None)}
    assert {(e.from_slug, e.to_slug, e.confidence) for e in resolve.call_edges(made).collect()} >= {("x", "a", "ambiguous"), ("x", "c", "corroborated")}
    foreign = resolve.external_hosts(spark.createDataFrame([("drive.google.com",), ("localhost",), ("orders",), ("orders.prod.example",)], "host string"), spark.createDataFrame([("orders",)], "slug string"))
    assert [r.host for r in foreign.collect()] == ["drive.google.com"] and services.count() == 5


def test_host_chain(spark):
    services = spark.createDataFrame([("orders", "9402", ""), ("orders-api", "", ""), ("notify", "", "Notification Core"), ("me", "", "")], "slug string, port string, name string")
    rows = [("K", "http://lb-7.example.com"), ("K", "x.pay.internal"), ("K", "orders.default.svc.cluster.local"), ("K", "orders-api-v2:80"), ("K", "reorders"), ("K", "localhost:9402"), ("NOTIFICATION_CORE.HOST", "localhost:1234"), ("A.ORDERS_URL", ""), ("K", "orders.stripe.com"), ("K", "me")]
    bindings = spark.createDataFrame([("me", k, v) for k, v in rows], "slug string, key string, value string").withColumns({"host": S.bare_host("value"), "port": S.bare_port("value")})
    declared = spark.createDataFrame([("me", 0, "lb-7.example.com", "orders"), ("me", 1, "*.pay.internal", "notify")], "slug string, pos int, pattern string, target string")
    got = {(r.value, r.key): (r.target, r.rule) for r in resolve.resolve_hosts(bindings, services, declared).collect()}
    assert got == {
        ("http://lb-7.example.com", "K"): ("orders", "exact"), ("x.pay.internal", "K"): ("notify", "glob"), ("orders.default.svc.cluster.local", "K"): ("orders", "k8s"), ("orders-api-v2:80", "K"): ("orders-api", "slug"),
        ("localhost:9402", "K"): ("orders", "port"), ("localhost:1234", "NOTIFICATION_CORE.HOST"): ("notify", "key"), ("", "A.ORDERS_URL"): ("orders", "key")}


def test_walk_caps_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "e"), ("a", "a")], "from_id string, to_id string").withColumn("relationship", F.lit("calls"))
    seed = spark.createDataFrame([("a",)], "id string")
    found, reached, cut = graph.walk(edges, seed, "out", 2, 300)
    assert {(r.from_id, r.to_id) for r in found.collect()} == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "e"), ("a", "a")} and {r.id for r in reached.collect()} == set("bcde") and not cut
    found, reached, cut = graph.walk(edges, seed, "out", 2, 2)
    assert {r.id for r in reached.collect()} == {"b"} and cut
    assert {r.id for r in graph.walk(edges, spark.createDataFrame([("d",)], "id string"), "in", 9, 300)[1].collect()} == {"b", "a"}


def test_mounts(spark):
    routers = spark.createDataFrame([("app", ""), ("api", "/v1"), ("orders", "/orders"), ("loop", "/l")], "key string, own string")
    mounts = spark.createDataFrame([("app", "api", "/x", "", False), ("api", "orders", "", "", False), ("app", "orders", "/flat", "", True), ("orders", "loop", "/a", "", False), ("loop", "orders", "/b", "", False)], "parent string, child string, prefix string, version string, replaces boolean")
    got = {}
    for r in graph.compose_prefixes(routers, mounts).collect():
        got.setdefault(r.key, set()).add(r.prefix)
    assert got["orders"] == {"/x/v1/orders", "/flat"} and got["loop"] == {"/x/v1/orders/a/l", "/flat/a/l"}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {(r.name, r.declared) for r in graph.resolve_aliases(chain, 6).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


def test_spans(spark):
    spans = spark.createDataFrame([("f", 1, 200, "out"), ("f", 10, 20, "b"), ("f", 12, 22, "c"), ("f", 12, 22, "d")], "path string, start int, end int, id string")
    points = spark.createDataFrame([("f", 15), ("f", 11), ("f", 150), ("f", 500), ("g", 1)], "path string, line int")
    assert {(r.path, r.line): r.id for r in intervals.tightest_span(points, spans).collect()} == {("f", 15): "d", ("f", 11): "b", ("f", 150): "out", ("f", 500): None, ("g", 1): None}
    assert {r.line: r.id for r in intervals.tightest_span(points, spans, "lowest").collect()}[15] == "b"
    at = spark.createDataFrame([("i", ["f:15", "f", "f:15"])], "id string, evidence array<string>")
    assert [(r.from_id, r.to_id) for r in intervals.handler_edges(at, spans).collect()] == [("i", "d")]


def test_lookup_tiers(spark):
    objects = spark.createDataFrame([("t:1:load", "t", "load", "static"), ("t:2:loader", "t", "loader", "static"), ("t:3:Download", "t", "Download", "static"), ("u:load", "u", "load", "static")], "id string, object_type string, name string, source string")
    assert [(r.tier, r.id) for r in lookup.find_tiered(objects, " load ", "t").collect()] == [(1, "t:1:load"), (2, "t:2:loader"), (3, "t:3:Download")]
    assert lookup.find_tiered(objects, "  ", "t").count() == 0 and lookup.find_tiered(objects, "load", "t", 1).count() == 1


def test_rules(spark):
    held = spark.createDataFrame([("r1", "", "contextual", ["Flask"], []), ("r2", "", "mandatory", [], []), ("r3", "", "recommended", ["flask"], ["ruby"]), ("r4", "", "draft", [], ["python"])], "id string, title string, status string, dependencies array<string>, languages array<string>")
    services = spark.createDataFrame([("s1", ["flask"], [], "Python"), ("s2", [], [], "auto")], "id string, dependencies array<string>, languages array<string>, language string")
    links = rules.governed_by(held, services)
    assert {(r.service, r.rule, tuple(r.matched)) for r in links.collect()} == {("s1", "r1", ("flask",)), ("s1", "r2", ()), ("s2", "r2", ()), ("s1", "r4", ("python",))}
    assert [(r.id, r.because) for r in rules.governing(links, held, "s1").collect()] == [("r2", "applies to every service"), ("r1", "flask"), ("r4", "python")]
    assert {r.id for r in rules.matchable(services).collect()} == {"s1"}


def test_vectors_and_enrichment(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("z", [0.0, 0.0]), ("c", [-1.0, 0.1])], "id string, vector array<float>")
    assert [(r.id, r.score) for r in semantic.top_k(vectors, [3.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    rows = spark.createDataFrame([("a", "t", "p", "h1"), ("b", "t", "q", "h2")], "id string, object_type string, prompt string, content_hash string")
    made = semantic.enrich(rows, rows.filter("id = 'a'"), lambda p: p + "!", lambda ts: [[float(len(t))] for t in ts], "fake").collect()
    assert [(r.object_id, r.summary, list(r.vector)) for r in made] == [("b", "q!", [2.0])]
    texts = spark.createDataFrame([("s", "get('/real') and \"x\"")], "slug string, text string")
    sites = spark.createDataFrame([("s", "f", 1, "e", "real"), ("s", "f", 2, "e", "made")], "slug string, file string, line int, expr string, context string")
    none = spark.createDataFrame([], "gap string"), spark.createDataFrame([], "slug string, method string, path string")
    got = semantic.fill_gaps(sites, none[0], none[1], texts, lambda c: 'x {"method": "get", "path": "/%s"}' % c).collect()
    assert [(r.method, r.path, r.source) for r in got] == [("GET", "/real", "llm")]


def test_grounded_in_any_quotes(spark, monkeypatch):
    """Whatever stands before a literal on its line, however long it is and whatever other quotes it holds."""
    long = "/" + "x" * 300
    texts = spark.createDataFrame([("s", 'f("", "/a/b")'), ("s", "don't call \"/c\""), ("s", f"'{long}' \"/it's\" '/q\"q' `/tick` \"/mixed'"), ("t", '"""doc""" "/d" "/é"'), (None, '"/n"'), ("t", None)], "slug string, text string")
    real = [("s", "/a/b"), ("s", "/c"), ("s", long), ("s", "/it's"), ("s", '/q"q'), ("t", "/d"), ("t", "/é")]
    made = [("t", "/a/b"), ("s", "/a"), ("s", "/tick"), ("s", "/mixed"), ("s", "/d"), (None, "/n"), ("s", None), ("u", "/d")]
    proposals = spark.createDataFrame(real + made + real[:1], "slug string, value string")
    for size, values in ((1 << 20, 100_000), (8, 2)):
        monkeypatch.setattr(semantic, "TEXT_BYTES", size)
        monkeypatch.setattr(semantic, "VALUES", values)
        assert sorted(map(tuple, semantic.grounded(proposals, texts).collect())) == sorted(real + real[:1])


def test_redaction_of_whole_texts(spark):
    """Credentials and opaque tokens count wherever they stand, and blanks stay."""
    rows = spark.createDataFrame([("see  postgres://me:pw@db/o\nand\t" + "A" * 30 + " \n",), (None,), ("",), ("plain words",)], "text string")
    got = [r.v for r in rows.select(S.redact_tokens("text").alias("v")).collect()]
    assert got == ["see  postgres://db/o\nand\t[redacted] \n", None, "", "plain words"]


def test_scores(spark):
    questions = spark.createDataFrame([(1, "service"), (2, "symbol"), (3, "service")], "qid int, entity string")
    truth = spark.createDataFrame([(1, 0, "orders", ["orders-copy"]), (1, 1, "billing", []), (2, 0, "A.run", [])], "qid int, pos int, item string, aliases array<string>")
    answers = spark.createDataFrame([(1, "Orders"), (1, "orders_copy"), (1, "ghost"), (1, "fine"), (2, "run")], "qid int, item string")
    fine = spark.createDataFrame([(1, "fine")], "qid int, item string")
    got = {r.qid: (r.tp, r.fp, r.fn, r.hallucinations, r.precision, r.recall) for r in quality.score_answers(answers, truth, questions, fine).collect()}
    assert got == {1: (1, 2, 1, 1, 0.3333, 0.5), 2: (1, 0, 0, 0, 1.0, 1.0), 3: (0, 0, 0, 0, 1.0, 1.0)}
