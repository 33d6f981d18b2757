"""Open versions: routed by pin, bounded, leased while open."""

from __future__ import annotations

import pytest
from test_catalog import objects

from weftgraph.catalog import Catalog, NoSuchVersion
from weftgraph.versions import Versions


def ids(catalog):
    return sorted(r.id for r in catalog.table("objects").collect())


def test_leases_and_bound(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    cache = Versions(spark, c.root, size=2)
    with pytest.raises(NoSuchVersion), cache.reading():
        pass
    first = c.commit(objects=objects(spark, "service:a"))
    with cache.reading() as old:
        second = c.commit(objects=objects(spark, "service:b"))
        third = c.commit(objects=objects(spark, "service:c"))
        assert c.sweep(0) == [second] and ids(old) == ["service:a"]
        with cache.reading() as new:  # the swap is seen at once
            assert new.version() == third and ids(new) == ["service:c"]
            fourth = c.commit(objects=objects(spark, "service:d"))
            with cache.reading() as newest:
                assert newest.version() == fourth and len(cache.versions()) == 3  # all in use
        assert cache.versions() == [first, third]  # the fourth was the only one out of use when one had to go
    c.pin("kept")
    with cache.reading("kept") as pinned, cache.reading("kept") as again:
        assert pinned is again and ids(pinned) == ["service:d"]
    with pytest.raises(NoSuchVersion), cache.reading("none"):
        pass
    assert cache.versions() == [third, fourth] and c.sweep(0) == [first]
    cache.close()
    assert cache.versions() == [] and c.sweep(0) == [third]


def test_a_lease_runs_out(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    first = c.commit(objects=objects(spark, "service:a"))
    lease = Catalog(spark, c.root, first).lease(minutes=60)
    c.commit(objects=objects(spark, "service:b"))
    assert c.sweep(0) == []
    c.renew(lease, minutes=-1)
    assert c.sweep(0) == [first] and not c.release(lease)
    with pytest.raises(NoSuchVersion):
        Catalog(spark, c.root, first).lease()
