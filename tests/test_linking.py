"""Links brought up to date equal links made anew, whatever came, changed or went; what a change does not reach keeps its rows."""

from __future__ import annotations

import json
import random

import pytest

from weftgraph import linking
from weftgraph.catalog import Catalog
from weftgraph.schema import EDGES, OBJECTS

NAMES = ("pay", "pay-api", "user", "orders", "mail", "stock")


def row(id, kind, slug, payload, source="static"):
    return (id, kind, slug, id.rsplit(":", 1)[-1], None, None, source, "static", None, json.dumps(payload))


def service(slug, calls=(), bindings=(), declared=None, port="", name="", deps=()):
    outbound = [{"verb": v, "path": p, "host": h, "evidence": "a.py:1"} for v, p, h in calls]
    bound = [{"key": k, "host": h, "port": p, "value": h, "file": "x.env"} for k, h, p in bindings]
    return row(f"service:{slug}", "service", slug, {"outbound": outbound, "host_bindings": bound, "declared_hosts": declared or {}, "identity": {"port": port, "name": name}, "dependencies": list(deps)})


def interface(slug, k, method, path, type="rest", framework="x"):
    return row(f"interface:{slug}:{k}", "interface", slug, {"type": type, "method": method, "path": path, "framework": framework})


def rule(id, status="mandatory", deps=(), langs=()):
    return row(f"guidance:{id}", "guidance", "book", {"status": status, "applies_to": {"dependencies": list(deps), "languages": list(langs)}})


def made_up(rng, slug):
    """A service with its interfaces, whose facts collide with those of others."""
    calls = [("get", f"/{rng.choice('ab')}/{rng.choice(('x', '{id}', '7'))}", rng.choice(("", "pay.example.com", "cdn.vendor.example", "user-host"))) for _ in range(rng.randint(0, 3))]
    bindings = [rng.choice((("PEER.HOST", "pay-api.internal", ""), ("PEER.HOST", "localhost", "9001"), ("USER_HOST", "", ""), ("PEERS.BOX_HOST", "", ""), ("DB.HOST", "ghost.svc", ""))) for _ in range(rng.randint(0, 2))]
    out = [service(slug, calls, bindings, {"ghost.*": "ghost"} if rng.random() < 0.4 else {}, rng.choice(("", "9001")), rng.choice(("", "box")), rng.choice(((), ("flask",), ("Spring",))))]
    for k in range(rng.randint(0, 2)):
        out.append(interface(slug, k, "GET", f"/{rng.choice('ab')}/{rng.choice(('x', ':id'))}"))
    for k in range(rng.randint(0, 2)):
        out.append(interface(slug, f"e{k}", rng.choice(("PUBLISH", "CONSUME", "USES")), rng.choice(("prod-jobs", "stag-jobs", "mails")), "event", rng.choice(("config", "messaging"))))
    return out


def state(catalog):
    whole = lambda t, skip=(): sorted(json.dumps({k: v for k, v in r.asDict().items() if k not in skip}, sort_keys=True, default=str) for r in t.collect())
    return whole(catalog.table("edges")), whole(catalog.table("objects"))


@pytest.mark.parametrize("seed", [2])
def test_equals_linking_anew(spark, tmp_path, seed):
    rng = random.Random(seed)
    one, other = Catalog(spark, str(tmp_path / "one")), Catalog(spark, str(tmp_path / "other"))
    steps = [[*(r for s in NAMES[:4] for r in made_up(rng, s)), rule("flask", deps=("flask",)), rule("all", "recommended")]]
    steps += rng.sample(("change", "add", "remove", "rule"), 3)
    some = False
    for step in steps:
        for c in (one, other):
            inner = random.Random(f"{seed}{steps.index(step)}")
            if isinstance(step, list):
                c.upsert_objects(spark.createDataFrame(step, OBJECTS))
            elif step == "rule":
                c.upsert_objects(spark.createDataFrame([rule("flask", inner.choice(("draft", "contextual")), (inner.choice(("flask", "spring")),))], OBJECTS))
            else:
                slug = inner.choice(NAMES[4:] if step == "add" else NAMES[:4])
                if step != "add":
                    c.delete([f"service:{slug}"], [f"interface:{slug}:"])
                if step != "remove":
                    c.upsert_objects(spark.createDataFrame(made_up(inner, slug), OBJECTS))
        linking.relink(one)
        linking.relink_changed(other)
        assert state(one) == state(other)
        some = some or bool(state(one)[0])
    assert some and linking.relink_changed(other) >= 0


def test_only_what_a_change_reaches(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    rows = [service("a", [("get", "/a/1", "")]), service("b", [("get", "/b/1", "")]), service("p"), service("q"), interface("p", 0, "GET", "/a/:id"), interface("q", 0, "GET", "/b/:id"),
            interface("p", 1, "PUBLISH", "prod-mails", "event"), interface("b", 1, "USES", "prod-mails", "event")]
    c.upsert_objects(spark.createDataFrame(rows, OBJECTS))
    assert linking.relink_changed(c) == -1 and linking.relink_changed(c) == 0
    ends = lambda: sorted((r.from_id[8:], r.relationship, r.to_id[8:], r.confidence) for r in c.table("edges").collect())
    assert ends() == [("a", "calls", "p", "high"), ("b", "calls", "q", "high"), ("p", "publishes_to", "b", "static")]
    c.upsert_objects(spark.createDataFrame([interface("q", 2, "GET", "/a/:key")], OBJECTS))
    assert linking.relink_changed(c) == 1  # the calls of a
    assert ends() == [("a", "calls", "p", "ambiguous"), ("a", "calls", "q", "ambiguous"), ("b", "calls", "q", "high"), ("p", "publishes_to", "b", "static")]
    c.delete(["interface:p:1"])
    assert linking.relink_changed(c) == 2  # the channels of p and b
    assert [e[:3] for e in ends()][-1] == ("b", "calls", "q")


def test_links_that_were_removed_or_added_by_hand(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.upsert_objects(spark.createDataFrame([service("a", [("get", "/a/1", "")]), service("p"), interface("p", 0, "GET", "/a/:id")], OBJECTS))
    linking.relink(c)
    whole = state(c)
    c.commit(edges=c.table("edges").limit(0))
    assert c.table("edges").count() == 0 and linking.relink_changed(c) == 1 and state(c) == whole
    c.replace_edges("resolver", spark.createDataFrame([], "id string"), spark.createDataFrame([("service:p", "calls", "service:a", "resolver", "high", *[None] * 7)], EDGES))
    assert linking.relink_changed(c) == 1 and state(c) == whole


def test_what_was_linked_outlives_a_sweep(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.upsert_objects(spark.createDataFrame([service("a", [("get", "/a/1", "")]), service("p")], OBJECTS))
    linking.relink(c)
    c.upsert_objects(spark.createDataFrame([interface("p", 0, "GET", "/a/:id")], OBJECTS))
    c.upsert_objects(spark.createDataFrame([service("z")], OBJECTS))
    c.sweep(0)
    assert linking.relink_changed(c) == 2 + 1  # calls of a; calls and rules of z
    assert [(r.from_id, r.to_id) for r in c.table("edges").collect()] == [("service:a", "service:p")]
