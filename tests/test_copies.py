"""Copies of a version: whole or not there; a torn one is refused."""

from __future__ import annotations

from pathlib import Path

import pytest
from test_catalog import edges, objects

from weftgraph import copies
from weftgraph.catalog import Catalog, NoSuchVersion


def ids(catalog):
    return sorted(r.id for r in catalog.table("objects").collect())


def test_killed_between_any_two_steps(spark, tmp_path, monkeypatch):
    c, to = Catalog(spark, str(tmp_path / "c")), str(tmp_path / "copy")
    with pytest.raises(NoSuchVersion):
        copies.copy_out(c, to)
    with pytest.raises(NoSuchVersion):
        copies.open_copy(spark, to)
    c.commit(objects=objects(spark, "service:a"), edges=edges(spark, ("service:a", "service:a")))
    first = copies.copy_out(c, to)
    assert copies.open_copy(spark, to, whole=True).version() == first
    c.upsert_objects(objects(spark, "service:b"))
    for dies_at in range(4):  # two tables, the manifest, the log
        done = iter(range(9))

        def dying(old):
            def step(*args, **more):
                if next(done) == dies_at:
                    raise OSError("killed")
                return old(*args, **more)
            return step

        with monkeypatch.context() as m:
            m.setattr(Catalog, "_write", dying(Catalog._write))
            m.setattr(Catalog, "_write_text", dying(Catalog._write_text))
            with pytest.raises(OSError, match="killed"):
                copies.copy_out(c, to)
        held = copies.open_copy(spark, to)
        assert held.version() == first and ids(held) == ["service:a"]
    second = copies.copy_out(c, to)
    held = copies.open_copy(spark, to, whole=True)
    assert held.version() == second and ids(held) == ["service:a", "service:b"] and held.table("edges").count() == 1


def test_torn_copies_are_refused(spark, tmp_path):
    c, to = Catalog(spark, str(tmp_path / "c")), tmp_path / "copy"
    c.commit(objects=objects(spark, "service:a", "interface:a:x"))
    with pytest.raises(copies.TornCopy, match="manifest"):
        copies.open_copy(spark, str(tmp_path / "c"))
    at = copies.copy_out(c, str(to))
    manifest = Path(to / "manifests" / f"{at}.json")
    manifest.write_text(manifest.read_text().replace('"content": [2', '"content": [3'))
    next(to.glob("manifests/.*.crc")).unlink()
    assert ids(copies.open_copy(spark, str(to))) == ["interface:a:x", "service:a"]
    with pytest.raises(copies.TornCopy, match="objects"):
        copies.open_copy(spark, str(to), whole=True)
    next(to.glob(f"versions/{at}/objects/object_type=service/*.parquet")).unlink()
    with pytest.raises(copies.TornCopy, match="objects"):
        copies.open_copy(spark, str(to))
