"""Point, prefix and substring lookups over objects(id, object_type, name, source, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STUB = "relationship_stub"
#: Letters of the pieces under which ids are found.
GRAM = 3


def clamp(value, default: int, low: int, high: int) -> int:
    try:
        return max(low, min(int(value), high))
    except (TypeError, ValueError):
        return default


def without_stubs(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("source") != STUB)


def list_objects(objects: DataFrame, object_type: str, include_stubs: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One type in id order; the offset counts only with a limit."""
    rows = objects.filter(F.col("object_type") == object_type)
    rows = (rows if include_stubs else without_stubs(rows)).orderBy("id")
    return rows if limit is None else rows.offset(offset).limit(limit)


def get_many(objects: DataFrame, ids: list[str]) -> DataFrame:
    """Objects by id in the order given; ids without one are left out."""
    wanted = objects.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return objects.join(F.broadcast(wanted), "id").orderBy("pos").select("pos", *objects.columns)


def list_under(objects: DataFrame, prefix: str, include_stubs: bool = False) -> DataFrame:
    rows = objects.filter(F.col("id").startswith(prefix))
    return (rows if include_stubs else without_stubs(rows)).orderBy("id")


def find_tiered(objects: DataFrame, query: str, object_type: str, limit: int = 20) -> DataFrame:
    """tier, id: exact name, then name prefix, then substring of the id without regard to case.

    One scan tags each row with its best tier; top-k by (tier, name within the prefix tier, id).
    """
    q = (query or "").strip()
    tier = F.when(F.col("name") == q, 1).when(F.col("name").startswith(q), 2).when(F.contains(F.lower("id"), F.lit(q.lower())), 3)
    rows = objects.filter(F.col("object_type") == object_type).select("id", "name", (tier if q else F.lit(None).cast("int")).alias("tier")).filter("tier is not null")
    return rows.orderBy("tier", F.when(F.col("tier") == 2, F.col("name")), "id").limit(limit).select("tier", "id")


# Lookup tables: what a catalog keeps so that a search reads few files.

def names(objects: DataFrame) -> DataFrame:
    return objects.select("object_type", "name", "id", "source")


def postings(objects: DataFrame) -> DataFrame:
    """object_type, gram, id: the distinct trigrams of every id, without regard to case."""
    low = F.lower("id")
    grams = F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substr(low, i, F.lit(GRAM)))))
    return objects.select("object_type", F.explode(grams).alias("gram"), "id")


def gram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("object_type", "gram").agg(F.count(F.lit(1)).alias("n"))


def find_indexed(held: dict[str, DataFrame], query: str, object_type: str, limit: int = 20) -> DataFrame:
    """``find_tiered`` on lookup tables: the same rows, without a scan of the objects.

    Names that equal or begin with the query are a range of the ordered names. For the rest the ids of the
    query's rarest trigram are read and tested, which is exact, as every id that holds the query is among them;
    of a query shorter than a trigram the ids of all trigrams that hold it, and the ids too short to have one.
    """
    q = (query or "").strip()
    names_ = held["names"].filter(F.col("object_type") == object_type)
    if not q:
        return names_.limit(0).select(F.lit(1).alias("tier"), "id")
    tier = F.when(F.col("name") == q, 1).otherwise(2)
    by_name = names_.filter(F.col("name").startswith(q)).select("id", "name", tier.alias("tier")).orderBy("tier", F.when(F.col("tier") == 2, F.col("name")), "id").limit(limit)
    low = q.lower()
    of_type = held["postings"].filter(F.col("object_type") == object_type)
    if len(low) >= GRAM:
        own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        counted = {r["gram"]: r["n"] for r in held["grams"].filter((F.col("object_type") == object_type) & F.col("gram").isin(*own)).collect()}  # a row per trigram of the query
        rarest = min(own, key=lambda g: (counted.get(g, 0), g))
        ids = of_type.filter(F.col("gram") == rarest).select("id")
    else:
        short = names_.filter(F.length("id") < GRAM).select("id")
        ids = of_type.filter(F.contains("gram", F.lit(low))).select("id").unionByName(short).distinct()
    hits = ids.filter(F.contains(F.lower("id"), F.lit(low)))
    # A hit that a name tier has stands there; there are at most ``limit`` better rows than any that is returned.
    inside = hits.orderBy("id").limit(2 * limit).select("id", F.lit(None).cast("string").alias("name"), F.lit(3).alias("tier"))
    best = by_name.unionByName(inside).groupBy("id").agg(F.min(F.struct("tier", "name")).alias("_t")).select("id", "_t.*")
    return best.orderBy("tier", F.when(F.col("tier") == 2, F.col("name")), "id").limit(limit).select("tier", "id")


def suggest(objects: DataFrame, given: str, object_type: str) -> DataFrame:
    """Five ids for an id that was not found: lookup of its last segment."""
    return find_tiered(objects, given.rsplit(":", 1)[-1], object_type, 5)


def list_interfaces(interfaces: DataFrame, service: str) -> DataFrame:
    return list_under(interfaces, f"interface:{service}:").orderBy(*(F.coalesce(c, F.lit("")) for c in ("type", "path", "method")), "id")


def unique_ids(rows: DataFrame, base: str, order: list) -> DataFrame:
    """The k-th row of a base id gets ``-k`` (k from 2) in the stated order."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("_k", k).withColumn("uid", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, "_k"))).drop("_k")


def round_robin(rows: DataFrame, group: str, name: str, order: list, limit: int) -> DataFrame:
    """One of each group per pass, groups in order; a name seen before takes its turn without being given again."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = rows.withColumn("turn", turn).groupBy(name).agg(F.min(F.struct("turn", group)).alias("first"))
    return ranked.select(name, F.col("first.turn").alias("turn"), F.col(f"first.{group}").alias(group)).orderBy("turn", group, name).limit(limit)


def merge_first(rows: DataFrame, keys: list[str], order: list, evidence: str, owner: str) -> DataFrame:
    """First row per key; its evidence grows by that of later rows of the same owner, the others are dead letters.

    Both steps are aggregates that are combined before the exchange; only the evidence that is returned is gathered.
    """
    first = rows.groupBy(*keys).agg(F.min_by(owner, F.struct(*order)).alias(owner))
    said = rows.join(first, [*keys, owner]).select(*keys, owner, F.explode_outer(evidence).alias("_e"))
    return said.groupBy(*keys, owner).agg(F.array_sort(F.collect_set("_e")).alias(evidence)).select(*keys, evidence, owner)


def by_type(objects: DataFrame) -> DataFrame:
    return objects.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


def index_info(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: objects, types, newest stamp, edges."""
    info = objects.agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("object_type").alias("types"), F.max("last_generated_at").alias("newest"))
    return info.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
