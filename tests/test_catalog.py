from __future__ import annotations

import json

import pytest

from weftgraph import export
from weftgraph.catalog import Catalog
from weftgraph.schema import EDGES, OBJECTS
from weftgraph.streaming.ingest import ingest


def objects(spark, *ids, payload="{}"):
    return spark.createDataFrame([(i, i.split(":")[0], i.split(":")[1], i.split(":")[-1], None, None, "static", "x", None, payload) for i in ids], OBJECTS)


def edges(spark, *pairs, source="static"):
    return spark.createDataFrame([(a, "calls", b, source, "high", *[None] * 7) for a, b in pairs], EDGES)


def test_delete_equals_rebuild(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.table("objects").count() == 0
    c.upsert_objects(objects(spark, "service:a", "interface:a:x", "service:a-b", "interface:a-b:x", payload='{"root": "/r/a"}'))
    c.replace_edges("static", spark.createDataFrame([], "id string"), edges(spark, ("service:a", "service:a-b"), ("interface:a:x", "service:a")))
    c.upsert_objects(objects(spark, "service:a-b", payload='{"root": "/r/b"}'))
    assert c.table("objects").count() == 4
    c.stamp({"a": "1", "b": "2"})
    c.stamp({"a": None})
    assert json.loads(c.meta()["repo_shas"]) == {"b": "2"}
    pinned = c.pin("before", reason="test")
    c.forget(["a"])
    assert {r.id for r in c.table("objects").collect()} == {"service:a-b", "interface:a-b:x"} and c.table("edges").count() == 0
    assert Catalog(spark, str(tmp_path / "c"), "before").table("objects").count() == 4
    assert [(p["alias"], p["days_left"]) for p in c.pins()] == [("before", 30)] and pinned["version"]
    assert c.extend("before", 5)["expires_at"] > pinned["expires_at"]
    with pytest.raises(ValueError, match="alias"):
        c.pin("-bad")
    assert pinned["version"] not in c.sweep(0) and c.unpin("before") and pinned["version"] in c.sweep(0)


def test_snapshot_keeps_valid_edges(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.load_snapshot("code_symbol:a:", objects(spark, "code_symbol:a:1", "code_symbol:a:2"), edges(spark, ("code_symbol:a:1", "code_symbol:a:2"), ("code_symbol:a:1", "gone:x")))
    assert c.table("edges").count() == 1
    c.load_snapshot("code_symbol:a:", objects(spark, "code_symbol:a:3"))
    assert [r.id for r in c.table("objects").collect()] == ["code_symbol:a:3"] and c.table("edges").count() == 0


def test_streamed_ingest(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    objects(spark, "service:a", "service:b").write.json(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "ck")).awaitTermination()
    first = c.version()
    ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "ck")).awaitTermination()
    assert c.version() == first and c.table("objects").count() == 2


def test_render(spark):
    services = spark.createDataFrame([("service:a", "A<"), ("service:b", "B")], "id string, name string")
    page = export.render(services, spark.createDataFrame([("service:a", "service:b", "high")], "from_id string, to_id string, confidence string"))
    assert page.count("<circle") == 2 and page.count("<line") == 1 and "A&lt;" in page
