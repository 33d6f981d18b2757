from __future__ import annotations

import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from weftgraph import index
from weftgraph.catalog import Catalog, ConcurrentCommit, NoSuchVersion
from weftgraph.operators import answers, gaps, quality, semantic
from weftgraph.schema import ENRICHMENTS, OBJECTS
from weftgraph.sources import providers

ORDERS = "from fastapi import FastAPI\nimport requests\napp = FastAPI()\n\n@app.get('/orders/{id}')\ndef order(id):\n    return bill(id)\n\ndef bill(id):\n    return requests.get(f'http://billing/invoices/{id}')\n"
BILLING = "from flask import Flask\napp = Flask(__name__)\n@app.route('/invoices/<id>')\ndef invoice(id):\n    return id\n"


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """A catalog of two repositories, one calling the other."""
    files = spark.createDataFrame([("orders", "app.py", ORDERS.encode()), ("billing", "web.py", BILLING.encode()), ("orders", "config.json", b'{"peers": {"BILLING_URL": "http://billing:80"}}')], "repo string, path string, content binary")
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("fleet") / "c"))
    assert index.index(catalog, files, {"orders": "1"}) == {"services": 2, "skipped": 0, "relinked": True}
    return catalog


def rows(table, *columns):
    return sorted(tuple(r[c] for c in columns) for r in table.collect())


def test_services_and_mesh(fleet):
    o, e = fleet.table("objects"), fleet.table("edges")
    said = answers.list_services(o)
    assert said.status == "ok" and rows(said.tables["services"], "id", "interfaces", "symbols") == [("service:billing", 1, 1), ("service:orders", 1, 2)]
    mesh = answers.get_service_graph(o, e, "high")
    assert rows(mesh.tables["edges"], "from_id", "to_id", "confidence") == [("service:orders", "service:billing", "corroborated")]
    assert rows(mesh.tables["services"], "id", "depends_on_count", "depended_on_by_count") == [("service:billing", 0, 1), ("service:orders", 1, 0)]
    assert rows(answers.get_service_relationships(o, e, "service:billing").tables["related"], "side", "id") == [("upstream", "service:orders")]
    assert rows(answers.list_interfaces(o, "service:orders").tables["interfaces"], "method", "path") == [("GET", "/orders/{id}")]
    assert answers.get_index_info(o, e).collected()["info"][0]["types"] == 3


def test_calls_and_symbols(fleet):
    o, e = fleet.table("objects"), fleet.table("edges")
    graph = answers.get_endpoint_call_graph(o, e, "interface:orders:get-orders-id")
    assert graph.status == "ok" and rows(graph.tables["handlers"], "id") == [("code_symbol:orders:app.py::order",)]
    assert answers.get_endpoint_call_graph(o, e, "interface:orders:get-order").status == "not_found"
    symbol = answers.get_symbol(o, e, "code_symbol:orders:app.py::bill")
    assert symbol.status == "ok" and rows(symbol.tables["symbol"], "name", "direct_callees", "direct_callers") == [("bill", 0, 0)]
    missing = answers.get_symbol(o, e, "code_symbol:orders:app.py::bil")
    assert missing.status == "not_found" and missing.about["expected_format"].startswith("code_symbol:")
    assert [r.id for r in answers.find_symbol(o, "bill", 1).tables["symbols"].collect()] == ["code_symbol:orders:app.py::bill"]
    assert answers.get_callees(o, e, "code_symbol:orders:app.py::order", "bad").about["max_depth"] == 2
    assert answers.get_callers(o, e, "code_symbol:orders:app.py::order", 99).about["max_depth"] == 6


def test_indexing_again_replaces(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = lambda text: spark.createDataFrame([("a", "x.py", text.encode())], "repo string, path string, content binary")
    index.index(catalog, made("from flask import Flask\napp = Flask(1)\n@app.route('/one')\ndef one(): ...\n"))
    index.index(catalog, made("from flask import Flask\napp = Flask(1)\n@app.route('/two')\ndef two(): ...\n"))
    assert rows(catalog.table("objects"), "id") == [("code_symbol:a:x.py::two",), ("interface:a:get-two",), ("service:a",)]
    assert rows(catalog.table("edges"), "from_id", "relationship", "to_id") == [("interface:a:get-two", "handled_by", "code_symbol:a:x.py::two")]
    assert catalog.forget(["a"], relink=lambda c: 1 / 0) == {"removed": ["service:a"], "relinked": False} and catalog.table("objects").count() == 0


def test_source_is_told_apart(spark, fleet):
    o = fleet.table("objects")
    texts = spark.createDataFrame([("app.py", 0, ORDERS)], "path string, rank int, text string")
    said = answers.source_of(o, texts, "code_symbol:orders:app.py::bill")
    assert said.status == "ok" and said.tables["source"].first()["span"]["text"].startswith("def bill(id):")
    assert answers.source_of(o, texts.limit(0), "code_symbol:orders:app.py::bill").status == "unavailable"


def test_guidance(spark):
    rule = lambda i, status, body, payload="": (f"guidance:{i}", "guidance", "", i, body, None, "static", "x", None, f'{{"status": "{status}", "scope": "s"{payload}}}')
    o = spark.createDataFrame([rule("a", "contextual", "Use a. More."), rule("b", "mandatory", "Use b. More.", ', "reviewed": "2024-01-02", "owner": "me"')], OBJECTS)
    vectors = spark.createDataFrame([("guidance:a", "guidance", "m", 2, None, "h", [1.0, 0.0]), ("guidance:b", "guidance", "m", 2, None, "h", [0.0, 1.0])], ENRICHMENTS)
    links = spark.createDataFrame([("service:x", "guidance:b", ["flask"])], "service string, rule string, matched array<string>")
    services = spark.createDataFrame([("service:x", ["flask"], [], "auto"), ("service:y", [], [], "auto")], "id string, dependencies array<string>, languages array<string>, language string")
    ask = lambda **k: answers.get_engineering_guidance(o, links, services, vectors, model="m", **k)
    embed = lambda texts: [[1.0, 0.1]] * len(texts)
    everything = ask()
    assert [(r.id, r.guidance, r.reviewed) for r in everything.tables["rules"].collect()] == [("guidance:b", "Use b.", "2024-01-02"), ("guidance:a", "Use a.", "never reviewed")]
    assert [(r.id, r.guidance, r.because) for r in ask(service="x").tables["rules"].collect()] == [("guidance:b", "Use b. More.", "flask")]
    assert ask(service="y").status == "unknown" and ask(service="z").status == "not_found"
    assert ask(topic="a").tables["rules"].first()["guidance"] == "Use a. More." and ask(topic="words").about["note"]
    assert [r.id for r in ask(topic="words", embed=embed).tables["rules"].collect()] == ["guidance:a", "guidance:b"]
    assert ask(topic="words", embed=embed, min_score=1.1).status == "no_match"
    assert [r.id for r in ask(topic="words", embed=embed, min_score=0.9).tables["rules"].collect()] == ["guidance:a"]
    assert answers.discover(o, vectors, "q", "guidance", "m", None).status == "unavailable" and answers.discover(o, vectors, "q", "guidance", "m", embed, 1).tables["results"].count() == 1


def test_gaps(spark):
    def ask(prompt):
        return {"one": 'so: {"method": "get", "path": "/real"}', "two": '{"direction": "publish", "channel": "orders"}', "three": '{"method": "GET", "path": "/made-up"}', "four": '{"resolved": false, "reason": "env"}',
                "five": '{"method": "GET", "path": "no slash"}', "six": "not json", "seven": '{"method": "GET", "path": "/known"}'}[prompt.split("Expression: ")[1].split("\n")[0]]

    kinds = {"one": "interface", "two": "event", "three": "interface", "four": "outbound", "five": "interface", "six": "interface", "seven": "interface"}
    sites = spark.createDataFrame([("s", k, "a.py", i, e, None, "snip", ["Model", "uri", "xy"]) for i, (e, k) in enumerate(kinds.items())], "slug string, kind string, file string, line int, expr string, method string, snippet string, names array<string>")
    symbols = spark.createDataFrame([("s", "code_symbol:s:m.py::uri", "m.py", "Model.uri", "method", 2, 3), ("s", "code_symbol:s:m.py::Model", "m.py", "Model", "class", 1, 3), ("t", "code_symbol:t:m.py::Model", "m.py", "Model", "class", 1, 3)],
                                    "slug string, id string, path string, qualname string, kind string, line_start int, line_end int")
    texts = spark.createDataFrame([("s", "m.py", "class Model:\n  def uri(cls):\n    return '/real'\nq = \"orders\"\nk = '/known'")], "slug string, path string, text string")
    none = spark.createDataFrame([], "gap string")
    known = spark.createDataFrame([("s", "GET", "/known")], "slug string, method string, path string")
    out = gaps.fill(sites, none, known, symbols, texts, ask)
    assert {(r.status, r.path) for r in out.collect()} == {("filled", "/real"), ("filled", "orders"), ("ungrounded", "/made-up"), ("unresolved", ""), ("malformed", "no slash"), ("duplicate", "/known")}
    assert {r.status: r.n for r in gaps.counters(out).collect()} == {"filled": 2, "ungrounded": 1, "unresolved": 2, "malformed": 1, "duplicate": 1}
    context = gaps.gap_context(sites.withColumn("gap", gaps.site_hash()).limit(1), symbols, texts).first()["context"]
    assert context == "# m.py:1 (class Model)\nclass Model:\n  def uri(cls):\n    return '/real'\n\n# m.py:2 (method Model.uri)\n  def uri(cls):\n    return '/real'"
    textual = gaps.gap_context(sites.withColumn("gap", gaps.site_hash()).limit(1), symbols.limit(0), texts).first()["context"]
    assert textual.startswith("# m.py:1\nclass Model:") and gaps.fill(sites, sites.select(gaps.site_hash().alias("gap")), known, symbols, texts, ask).count() == 0


def test_providers_try_again():
    waits, codes = [], [503, 429, 200]

    def send(url, body, headers, timeout):
        code = codes.pop(0)
        if code != 200:
            raise urllib.error.HTTPError(url, code, "x", {}, None)
        return {"response": " said ", "embeddings": [[1.0]]}

    model = providers.HttpModel("http://x", "m", send=send, sleep=waits.append)
    assert model.complete("p") == "said" and waits == [1.0, 2.0]
    codes[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        model.complete("p")
    codes[:] = [200]
    with pytest.raises(RuntimeError):
        model.embed(["a", "b"])
    codes[:] = [500] * 4
    with pytest.raises(urllib.error.HTTPError):
        model.complete("p")


def test_enrichment_by_kind(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = lambda kind: lambda: spark.createDataFrame([(f"{kind}:{i}", kind, f"prompt {i}", f"h{i}") for i in range(3)], "id string, object_type string, prompt string, content_hash string")
    run = lambda: semantic.enrich_all(catalog, {k: made(k) for k in ("service", "interface")}, lambda p: p + "\nsecond", lambda t: [[1.0] for _ in t], "m")
    assert run() == {"interface": 3, "service": 3} and run() == {"interface": 0, "service": 0}
    assert {(r.object_id, r.summary) for r in catalog.table("enrichments").filter("object_id like '%:1'").collect()} == {("interface:1", "prompt 1"), ("service:1", "prompt 1\nsecond")}
    assert answers.enrichment_hashes(catalog.table("enrichments"), "service", "m").count() == 3
    assert semantic.trimmed("One. Two is long.", "library") == "One. Two is long." and semantic.trimmed("A" * 150 + ". " + "B" * 300, "interface") == "A" * 150 + "." and semantic.exported_names(["  a(x)  y", "", "b"]) == ["a(x)", "b"]
    rules = spark.createDataFrame([("guidance:a", "T", "body", "h")], "id string, title string, body string, content_hash string")
    stored = semantic.embed_rules(rules, spark.createDataFrame([], "id string, content_hash string"), lambda t: [[2.0] for _ in t], "m").collect()
    assert [(r.object_type, r.summary) for r in stored] == [("guidance", "T\nbody")]


def test_readers_never_see_half_a_catalog(spark, tmp_path):
    """Readers beside a writer always find a version, and a whole one."""
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = lambda n: spark.createDataFrame([(f"service:{n}", "service", "", str(n), None, None, "static", "x", None, "{}")], OBJECTS)
    catalog.upsert_objects(made(0))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append((catalog.version(), set(catalog._tables())))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 8):
        catalog.commit(meta=spark.createDataFrame([("k", str(n))], "key string, value string"))
    stop.set()
    reader.join()
    assert seen and all(v and "objects" in t for v, t in seen) and catalog.meta() == {"k": "7"} and catalog.table("objects").count() == 1


def test_commits_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    a = Catalog(spark, str(tmp_path / "c"))
    meta = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    a.commit(meta=meta("0"))
    log = a._log()
    b = Catalog(spark, str(tmp_path / "c"))
    calls = iter([log, None])
    real = Catalog._log
    monkeypatch.setattr(b, "_log", lambda: next(calls) or real(b))
    a.commit(meta=meta("1"))
    with pytest.raises(ConcurrentCommit):
        b.commit(meta=meta("2"))
    assert a.meta() == {"k": "1"}
    with pytest.raises(NoSuchVersion):
        Catalog(spark, str(tmp_path / "c"), "no-such-pin").table("objects")
    assert Catalog(spark, str(tmp_path / "none")).table("objects").count() == 0


def test_run_streams(spark):
    text = "x ```json\n{\"answer\": [1]}\n``` y ```json\n{\"answer\": [2]}\n``` ```json\n{bad\n``` ```json\n{\"other\": 1}\n```"
    assert {r.id: r.answer for r in quality.final_answers(spark.createDataFrame([(1, text), (2, "none")], "id long, text string")).collect()} == {1: '{"answer": [2]}', 2: None}
    lines = ['{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "a"}, {"type": "text"}]}}', "junk", '{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "b"}]}}', '{"type": "result", "modelUsage": {"m": {"inputTokens": 3}}}', '{"type": "result", "modelUsage": {"m": {"inputTokens": 5, "outputTokens": 1}}}']
    row = quality.usage(spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "id long, pos int, line string")).first()
    assert (row.tools, row.input_tokens, row.output_tokens, row.cache_read_input_tokens) == (["a", "b"], 5, 1, 0)
    steps = quality.Steps()
    with steps("a"), steps("b"):
        pass
    assert {n for n, *_ in steps.totals()} == {"a", "b"} and sum(share for *_, share in steps.totals()) == pytest.approx(1)


def test_percentiles_of_ties_and_extremes(spark):
    values = [(g, float(v)) for g, many in (("a", [1] * 50 + [2] * 50), ("b", [7]), ("c", range(1000)), (None, [3, 4])) for v in many]
    out = {r.g: (r.n, r.p50, r.p95, r.p99, r.max) for r in quality.latency(spark.createDataFrame([*values, ("a", None)], "g string, v double"), "g", "v").collect()}
    assert out == {"a": (100, 1.5, 2.0, 2.0, 2.0), "b": (1, 7.0, 7.0, 7.0, 7.0), "c": (1000, 499.5, 950.0, 990.0, 999.0), None: (2, 3.5, 4.0, 4.0, 4.0)}
    assert F is not None
