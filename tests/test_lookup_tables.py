"""Lookups that skip files: the plan filters at the scan, few files hold an answer, and the rows are those of the scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.operators import lookup
from weftgraph.schema import OBJECTS


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abAB:.é-") for _ in range(r.randrange(0, 7)))
    rows = [(f"part:{i:04}{word()}" if i % 50 else f"x{i % 10}"[: 1 + i % 2] + ("" if i % 100 else "q"), word() or None) for i in range(600)]
    rows = list({a: (a, "part" if k % 3 else "tool", b) for k, (a, b) in enumerate(rows)}.values())
    table = spark.createDataFrame(rows, "id string, object_type string, name string")
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in OBJECTS.split(", ")}
    objects = table.select(*(F.col(c) if c in table.columns else F.lit("static" if c == "source" else None).cast(k).alias(c) for c, k in kinds.items()))
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("lookup") / "c"))
    catalog.commit(objects=objects)
    return catalog, [r[0] for r in rows] + [r[2] for r in rows if r[2]]


def test_the_same_rows_as_the_scan(held):
    catalog, said = held
    assert catalog.lookup() is None
    catalog.build_lookup()
    tables, objects, r = catalog.lookup(), catalog.table("objects"), random.Random(9)
    queries = ["", "  ", "a", "A", "ab", "é", "part:", "zzz", "x", "q", "0"] + [w[a : a + r.randrange(1, 6)] for w in r.sample(said, 14) for a in [r.randrange(0, max(1, len(w)))]]
    for q in queries:
        want = [(x.tier, x.id) for x in lookup.find_tiered(objects, q, "part", 7).collect()]
        assert [(x.tier, x.id) for x in lookup.find_indexed(tables, q, "part", 7).collect()] == want, q


def test_stale_lookup_tables_are_refused(spark, held, tmp_path):
    catalog = held[0]
    if catalog.lookup() is None:
        catalog.build_lookup()
    other = Catalog(spark, str(tmp_path / "c"))
    objects = catalog.table("objects")
    other.commit(objects=objects.limit(50))
    first = other.build_lookup()
    assert other.lookup() is not None
    other.stamp({"a": "1"})
    assert other.lookup() is not None  # the objects are the same
    other.pin("before")
    other.commit(objects=objects.limit(20))
    assert other.lookup() is None and Catalog(spark, other.root, "before").lookup() is not None and Catalog(spark, other.root, first).lookup() is not None


def test_points_and_prefixes_skip_files(spark, tmp_path):
    """A point lies within the bounds of one file, a prefix within those of a few; filters reach the scan."""
    catalog = Catalog(spark, str(tmp_path / "c"))
    ids = spark.range(4000).select(F.concat(F.lit("s:"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"))
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in OBJECTS.split(", ")}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.commit(objects=ids.select(*(F.col(c) if c == "id" else F.lit({"object_type": "s"}.get(c)).cast(k).alias(c) for c, k in kinds.items())))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    objects = catalog.table("objects")
    bounds = objects.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    assert len(bounds) >= 4 and sum(b.low <= "s:02000" <= b.high for b in bounds) == 1 and sum(b.low <= "s:020￿" and b.high >= "s:020" for b in bounds) <= 2
    for rows in (objects.filter("id = 's:02000'"), lookup.list_under(objects, "s:020", True)):
        assert "PushedFilters: [IsNotNull(id)" in rows._jdf.queryExecution().executedPlan().toString()
