"""Call edges that are products: kept as groups and members, read as the edges that they stand for."""

from __future__ import annotations

import random

import pytest
from test_linking import interface, made_up, rule, service, state

from weftgraph import catalog, copies, linking
from weftgraph.catalog import Catalog
from weftgraph.schema import EDGES, OBJECTS


def test_pairs_are_not_written(spark, tmp_path, monkeypatch):
    """320 callers of 320 providers: 102,400 edges are read, and what is written is in proportion to the services."""
    monkeypatch.setattr(catalog, "PAIRS", 30_000, raising=False)
    c = Catalog(spark, str(tmp_path / "c"))
    rows = [service(f"c{k}", [("get", "/a/1", "p7" if k == 5 else "")], [("PEER.HOST", "p9.internal", "")] if k == 6 else ()) for k in range(320)]
    rows += [r for k in range(320) for r in (service(f"p{k}"), interface(f"p{k}", 0, "GET", "/a/:id"))]
    c.upsert_objects(spark.createDataFrame(rows, OBJECTS))
    linking.relink(c)
    linked = c.table("edges")
    assert linked.count() == linked.select("from_id", "to_id").distinct().count() == 102_400
    assert [tuple(r) for r in linked.filter("confidence <> 'ambiguous'").select("from_id", "to_id", "confidence").sort("from_id").collect()] == [
        ("service:c5", "service:p7", "corroborated"), ("service:c6", "service:p9", "corroborated")]
    c.delete(["interface:p3:0"])  # writes each edge by itself
    assert c.table("edges").count() == 102_400
    linking.relink_changed(c)
    assert c.table("edges").count() == 320 * 319 and c.table("edges").filter("to_id = 'service:p3'").isEmpty()
    written = {name: spark.read.parquet(f"{c.root}/{place}").count() for name, place in c._tables().items() if not name.endswith("objects")}
    assert max(written.values()) <= 1000


@pytest.mark.parametrize("seed", [3])
def test_groups_equal_single_edges(spark, tmp_path, monkeypatch, seed):
    """The same edges, linked whole or by what changed, with groups or without; groups that no change reaches stay beside new ones."""
    rng = random.Random(seed)
    one, other = Catalog(spark, str(tmp_path / "one")), Catalog(spark, str(tmp_path / "other"))
    names = ("pay", "pay-api", "user", "orders")
    calls = [service("x", [("get", "/z/1", "cdn.vendor.example"), ("get", "/a/x", "y-host")], [("PEER.HOST", "y", "")]), service("y", [("get", "/z/2", "")]), interface("y", 0, "GET", "/z/:id"), interface("ghost", 0, "GET", "/z/:id"),
             service("w", [("get", "/q/1", "")]), interface("v", 0, "GET", "/q/:id")]
    steps = [[*(r for s in names for r in made_up(rng, s)), *calls, rule("flask", deps=("flask",))], [interface("late", 0, "GET", "/q/:id")]]
    for step in steps:
        for c in (one, other):
            c.upsert_objects(spark.createDataFrame(step, OBJECTS))
        monkeypatch.setattr(linking, "MAX_SINGLE", 10**9)
        linking.relink(one)
        monkeypatch.setattr(linking, "MAX_SINGLE", -1)
        linking.relink_changed(other)
        assert state(one) == state(other)
        assert "groups" in other._tables() and "groups" not in one._tables()
    groups, members = other.edge_parts()[1]
    assert groups.select("cls").distinct().count() == members.select("cls").distinct().count()
    assert len({r.cls.split(":")[0] for r in groups.collect()}) > 1  # of several linkings
    copies.copy_out(other, str(tmp_path / "copy"))
    assert state(copies.open_copy(spark, str(tmp_path / "copy"), whole=True)) == state(other)
    linked = other.linked()["edges"]
    assert linked.count() == other.table("edges").count()
    other.commit(edges=spark.createDataFrame([], EDGES))
    assert other.table("edges").isEmpty() and other.linked()["edges"].count() == linked.count()
    linking.relink_changed(other)
    assert state(one) == state(other)
