"""Indexing whole repositories: code indexes, dependencies, languages, rules and dead letters reach the catalog; a bad one stays alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph import index
from weftgraph.catalog import Catalog
from weftgraph.operators import answers
from weftgraph.sources import registry

APP = "from flask import Flask\nimport requests\napp = Flask(__name__)\n\n@app.route('/orders/<id>')\ndef order(id):\n    return bill(id)\n\n\ndef bill(id):\n    return tax(id)\n\n\ndef tax(id):\n    return requests.get(url_of(id))\n"
RULE = "---\nkind: guidance\nid: {id}\ntitle: {id} title\nstatus: {status}\napplies_to:\n  dependencies: [{dep}]\n---\nDo {id}.\n"


def field(number, body):
    if isinstance(body, int):
        return varint(number << 3) + varint(body)
    return varint(number << 3 | 2) + varint(len(body)) + body


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def code_index(path, occurrences):
    """A binary code index of one document: (symbol, zero-based line, is it the definition)."""
    rows = b"".join(field(2, field(1, varint(line) + varint(0) + varint(1)) + field(2, symbol.encode()) + field(3, int(defines))) for symbol, line, defines in occurrences)
    return field(2, field(1, path.encode()) + rows)


CALLS = code_index("app.py", [("order().", 5, True), ("bill().", 6, False), ("bill().", 9, True), ("tax().", 10, False), ("tax().", 13, True), ("local 1", 13, False)])


def made(spark, repos):
    rows = [(repo, path, text if isinstance(text, bytes) else text.encode()) for repo, files in repos.items() for path, text in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def rows(table, *columns):
    return sorted(tuple(r[c] for c in columns) for r in table.collect())


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("index") / "c"))
    files = made(spark, {
        "orders": {"app.py": APP, "index.scip": CALLS, "requirements.txt": "Flask>=2\nrequests\n", "b.py": "x = 1\n", "README.md": "# Orders\nTakes orders.\n"},
        "copy": {"app.py": APP, "index.scip": CALLS},
        "web": {"a.ts": "export function a() { }\n", "b.ts": "class B { run() { } }\n", "package.json": '{"dependencies": {"express": "1"}}'},
        "book": {"weftgraph.yaml": "guidance: [rules]\n", "rules/one.md": RULE.format(id="flask-first", status="mandatory", dep="flask"), "rules/two.md": RULE.format(id="spring", status="recommended", dep="spring"), "rules/bad.md": "---\nkind: guidance\nid: x\n---\nno title\n", "else/three.md": RULE.format(id="elsewhere", status="mandatory", dep="flask")},
    })
    report = index.index(catalog, files, {"orders": "1"})
    assert report == {"services": 4, "skipped": 3, "relinked": True}
    return catalog


def test_calls_between_symbols(fleet):
    o, e = fleet.table("objects"), fleet.table("edges")
    assert rows(e.filter("relationship = 'calls' and source = 'static'"), "from_id", "to_id", "weight") == sorted(
        (f"code_symbol:{r}:app.py::{a}", f"code_symbol:{r}:app.py::{b}", 1) for r in ("orders", "copy") for a, b in (("order", "bill"), ("bill", "tax")))
    down = answers.get_callees(o, e, "code_symbol:orders:app.py::order", 3)
    assert down.status == "ok" and rows(down.tables["nodes"], "name") == [("bill",), ("tax",)] and rows(down.tables["edges"], "to", "weight") == [("code_symbol:orders:app.py::bill", 1), ("code_symbol:orders:app.py::tax", 1)]
    assert rows(answers.get_callers(o, e, "code_symbol:orders:app.py::tax", 1).tables["nodes"], "name") == [("bill",)]
    trace = answers.get_endpoint_call_graph(o, e, "interface:orders:get-orders-id")
    assert trace.status == "ok" and rows(trace.tables["handlers"], "id") == [("code_symbol:orders:app.py::order",)]


def test_symbols_of_repositories_without_a_code_index(fleet):
    assert rows(fleet.table("objects").filter("slug = 'web' and object_type = 'code_symbol'"), "id") == [("code_symbol:web:a.ts::a",), ("code_symbol:web:b.ts::B",), ("code_symbol:web:b.ts::B.run",)]
    assert answers.payload(fleet.table("objects"), "code_symbol").filter("length(file_sha) = 12").count() == 9


def test_what_services_say_of_themselves(fleet):
    held = {r.slug: r for r in answers.payload(fleet.table("objects"), "service").collect()}
    assert held["orders"].dependencies == ["flask", "requests"] and held["orders"].languages == ["python"] and held["web"].dependencies == ["express"] and held["web"].languages == ["typescript"]
    assert "Takes orders." in held["orders"].purpose[1]
    assert [(s.file, s.reason) for s in held["orders"].skipped] == [("app.py", "non-literal-url")] and [(s.file, s.reason) for s in held["book"].skipped] == [("rules/bad.md", "refused-rule")]


def test_rules_and_whom_they_govern(fleet):
    o, e = fleet.table("objects"), fleet.table("edges")
    assert rows(o.filter("object_type = 'guidance'"), "id") == [("guidance:flask-first",), ("guidance:spring",)]
    assert rows(e.filter("relationship = 'governed_by'"), "from_id", "to_id", "matched", "status") == [("service:orders", "guidance:flask-first", ["flask"], "mandatory")]
    links, services = index.governance(o, e)
    said = answers.get_engineering_guidance(o, links, services, service="orders")
    assert said.status == "ok" and rows(said.tables["rules"], "title", "because") == [("flask-first title", "flask")]
    assert answers.get_engineering_guidance(o, links, services, service="none").status == "not_found"


def test_a_withdrawn_rule_goes(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    book = {"weftgraph.yaml": "guidance: .\n", "one.md": RULE.format(id="one", status="mandatory", dep="flask")}
    app = {"requirements.txt": "flask\n", "a.py": "def f(): ...\n"}
    index.index(catalog, made(spark, {"book": book | {"two.md": RULE.format(id="two", status="mandatory", dep="flask")}, "app": app}))
    assert catalog.table("edges").filter("relationship = 'governed_by'").count() == 2
    index.index(catalog, made(spark, {"book": book}))
    assert rows(catalog.table("objects").filter("object_type = 'guidance'"), "id") == [("guidance:one",)]
    assert rows(catalog.table("edges"), "from_id", "to_id") == [("service:app", "guidance:one")]


def test_one_bad_repository_of_many(spark, tmp_path):
    def broken(files):
        raise_on = F.when(F.decode("content", "UTF-8") == "boom", F.raise_error(F.concat(F.lit("cannot read "), "repo")).cast("string"))
        return files.filter(F.col("path").endswith(".txt")).select("repo", F.col("path").alias("file"), F.lit("note").alias("fact"), raise_on.alias("name"))

    catalog = Catalog(spark, str(tmp_path / "c"))
    repos = {f"r{i:02}": {"a.py": f"def f{i}(): ...\n", "n.txt": "boom" if i == 5 else "fine"} for i in range(6)}
    events = []
    report = index.index_fleet(catalog, made(spark, repos), dict.fromkeys(repos, "1"), (*registry.ADAPTERS, registry.Adapter("broken", broken)), jobs=2, groups=3, progress=lambda e, a: events.append(e))
    assert report["ok"] == [f"r{i:02}" for i in range(6) if i != 5] and [f[0] for f in report["failed"]] == ["r05"] and "cannot read r05" in report["failed"][0][1] and report["relinked"]
    assert rows(catalog.table("objects").filter("object_type = 'code_symbol'"), "id") == [(f"code_symbol:r{i:02}:a.py::f{i}",) for i in range(6) if i != 5]
    assert "repo-failed" in events and events.count("group-done") >= 2 and "r05" not in catalog.meta()["repo_shas"]
