"""Sharding by K-d tree: recursive splits at distributed weighted medians along the widest dimension.

Rows with equal texts are a group and share the metadata of its least row: id, size, language, source. Each
row has one integer key per dimension, whose high bits are that coordinate, the bits below a hash of the text,
the lowest a hash of the row: a group stays together, yet one of any size can be split. A level of the
tree costs one aggregation for the extents and a few for the medians, which are found by refining histograms
until the bin that holds the median weighs next to nothing or is a small group. Extents, histograms and their
running sums are DataFrame aggregations over rows that carry their node; the driver sees a row per node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace, only, skew_safe_join, with_rank

#: Bits of a key: coordinate, text, row.
COORD_BITS, TEXT_BITS, ROW_BITS = 24, 22, 17
TIE_BITS = TEXT_BITS + ROW_BITS
BIN_BITS = 10
#: A split may miss its share by this part of a shard; a group up to that part of a shard is not split.
TOLERANCE, WHOLE_GROUP = 0.001, 0.05
DIMENSIONS = ("doc_id", "size", "lang", "source")
KEYS = [f"k{i}" for i in range(len(DIMENSIONS))]
SHARDS = 24
#: Nodes whose split rows are broadcast; with more they are joined by node.
MAX_BROADCAST = 20_000


def _scaled(value: Column, low: float, high: float) -> Column:
    top = (1 << COORD_BITS) - 1
    return F.coalesce(F.least(F.lit(top), F.floor((value - low) / max(high - low, 1e-9) * top)), F.lit(0)).cast("long")


def _by_rank(rows: DataFrame, name: str, total: int, space: Workspace) -> DataFrame:
    """``rows`` with the text column ``name`` replaced by its place among the distinct values in code-point order, spread over a coordinate's range; null is the least.

    The distinct values are sorted and numbered in parallel, a range of the order per task; the driver sees
    the number of values of each range. Values find their rows by broadcast up to a checked number of them,
    beyond that by a join that splits hot ones.
    """
    counted = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_c"))
    ranges = space.save(counted.orderBy(name).select(name, "_c", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in")), f"order{name}")
    sizes = sorted((r["_range"], r["n"]) for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, n = [], 0
    for k, size in sizes:
        before.append((k, n))
        n += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _past long"))
    place = F.floor((F.col("_past") + F.col("_in") + 1) * float((1 << COORD_BITS) - 1) / max(n, 1)).cast("long").alias("_place")
    places = ranges.join(offsets, "_range").select(name, "_c", place)
    if n <= MAX_BROADCAST:
        placed = rows.join(F.broadcast(places.drop("_c")), name, "left")
    else:
        placed = skew_safe_join(rows.filter(F.col(name).isNotNull()), places, name, "_c", total).drop("_c").unionByName(rows.filter(F.col(name).isNull()).withColumn("_place", F.lit(None).cast("long")))
    return placed.withColumn(name, F.coalesce("_place", F.lit(0))).drop("_place")


def _per_node(rows: DataFrame, made: list[tuple], schema: str) -> DataFrame:
    """Rows joined with what is known of their nodes."""
    nodes = rows.sparkSession.createDataFrame(made, schema)
    return rows.join(F.broadcast(nodes) if len(made) <= MAX_BROADCAST else nodes, "node")


def _step(bits: int) -> int:
    """Bits below the bins of the next histogram of a range of 2 ** bits keys; one histogram ends where the rows of a text begin."""
    return max(ROW_BITS if bits > ROW_BITS else 0, bits - BIN_BITS)


def _medians(rows: DataFrame, wanted: dict[int, tuple[int, float]], share: float) -> dict[int, int]:
    """Per node (dimension, weight wanted below): the key that splits it there; ``share`` is the weight of a shard."""
    state = {n: (d, 0, COORD_BITS + TIE_BITS, want) for n, (d, want) in wanted.items()}
    done: dict[int, int] = {}
    while state:
        made = [(n, d, low, bits, _step(bits), float(want)) for n, (d, low, bits, want) in state.items()]
        at = _per_node(rows, made, "node long, dimension int, low long, bits int, step int, want double").withColumn("_x", F.element_at(F.array(*KEYS), F.col("dimension") + 1) - F.col("low"))
        inside = at.filter((F.col("_x") >= 0) & F.expr("shiftright(_x, bits) = 0"))
        counted = inside.groupBy("node", "want", F.expr("shiftright(_x, step)").alias("bin")).agg(F.sum("weight").alias("w"))
        sums = counted.withColumn("past", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))  # at most 2 ** BIN_BITS rows a node
        found = {r["node"]: r["b"] for r in sums.filter("past > want").groupBy("node").agg(F.min(F.struct("bin", "w", "past")).alias("b")).collect()}
        for n, (d, low, bits, want) in list(state.items()):
            step = _step(bits)
            if n not in found:  # all of it is wanted below
                done[n] = low + (1 << bits)
                del state[n]
                continue
            cut, weight, before = found[n]["bin"], found[n]["w"], found[n]["past"] - found[n]["w"]
            if step == 0 or weight <= (WHOLE_GROUP if step == ROW_BITS else TOLERANCE) * share:
                closer = want - before > before + weight - want
                done[n] = low + (cut + bool(closer) << step)
                del state[n]
            else:
                state[n] = (d, low + (cut << step), step, want - before)
    return done


def grow(rows: DataFrame, leaves: int, total: float, space: Workspace) -> DataFrame:
    """``rows`` (weight, keys and more) with ``shard``: the number of the leaf that each falls into."""
    at, first, count = rows.withColumn("node", F.lit(0).cast("long")), {0: 0}, {0: leaves}
    level = 0
    while any(n > 1 for n in count.values()):
        at = space.save(at, f"level-{level}")
        open_ = [(n, c // 2 / c) for n, c in count.items() if c > 1]
        wide = _per_node(at, open_, "node long, part double").groupBy("node", "part").agg(
            F.sum("weight").alias("w"),
            *(F.max(F.shiftright(k, TIE_BITS)).alias(f"h{k}") for k in KEYS), *(F.min(F.shiftright(k, TIE_BITS)).alias(f"l{k}") for k in KEYS),
        ).collect()
        wanted = {r["node"]: (max(range(len(KEYS)), key=lambda i, r=r: (r[f"h{KEYS[i]}"] - r[f"l{KEYS[i]}"], -i)), r["w"] * r["part"]) for r in wide}
        keys = _medians(at, wanted, total / leaves)
        made = [(n, wanted[n][0], keys[n]) if n in keys else (n, 0, 0) for n, _ in open_]  # a node without rows splits anywhere
        split = F.broadcast if len(made) <= MAX_BROADCAST else lambda x: x
        low = F.element_at(F.array(*KEYS), F.col("_dimension") + 1) < F.col("_key")
        at = at.join(split(at.sparkSession.createDataFrame(made, "node long, _dimension int, _key long")), "node", "left").withColumn(
            "node", F.when(F.col("_key").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(low, 1).otherwise(2))).drop("_dimension", "_key")
        for n, _ in open_:
            c, f = count.pop(n), first.pop(n)
            count |= {2 * n + 1: c // 2, 2 * n + 2: c - c // 2}
            first |= {2 * n + 1: f, 2 * n + 2: f + c // 2}
        level += 1
    return _per_node(at, list(first.items()), "node long, shard int")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard; leaves of near equal bytes.

    ``target_bytes``: as many leaves as bring the mean of a leaf to it; or ``shards`` leaves. Size is the
    UTF-8 bytes of the text (null: none) plus 8. Language and source are coordinates by their rank among the
    distinct values, whole names in code-point order. Null metadata counts as the least coordinate. Rows of one
    text share a shard unless they weigh more than ``WHOLE_GROUP`` of it; a larger group is split between
    rows, and rows that tie in text and id share a shard. One document larger than a shard makes its shard
    that large. An empty table gives an empty result. Other columns are not read; a text of any length is
    read once, for its hashes and its length.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    body = F.coalesce(F.col("text"), F.lit(""))
    base = only(docs, "doc_id", "text", "lang", "source").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
    )
    space = Workspace(docs.sparkSession, "sharding")
    slim = space.save(base, "slim")
    seen = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("size").alias("most")).first()
    total = float(seen["w"] or 0)
    leaves = shards or max(1, int(-(-total // target_bytes)))
    for name in ("_lang", "_source"):
        slim = _by_rank(slim, name, seen["n"], space)
    groups = space.save(slim.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "_lang", "_source")).alias("_of")), "groups")
    tie = F.shiftleft(F.col("_text").bitwiseAND((1 << TEXT_BITS) - 1), ROW_BITS) + F.xxhash64("doc_id", "text_crc32").bitwiseAND((1 << ROW_BITS) - 1)
    coordinates = (
        _scaled(F.col("_of.doc_id"), float(seen["lo"] or 0), float(seen["hi"] or 0)),
        _scaled(F.log("size"), 2.0, float(np.log(max(seen["most"] or 9, 9)))), F.col("_of._lang"), F.col("_of._source"),
    )
    keys = skew_safe_join(slim, groups, "_text", "_n", seen["n"]).select("doc_id", "size", "text_crc32", F.col("size").alias("weight"), *(
        (F.shiftleft(c, TIE_BITS) + tie).alias(k) for k, c in zip(KEYS, coordinates, strict=True)))
    placed = space.save(grow(keys, leaves, total, space).select("doc_id", "size", "text_crc32", "shard"), "placed")
    ranked = with_rank(placed, "shard", [F.col("doc_id"), F.col("text_crc32")], [F.col("doc_id"), F.col("text_crc32")], seen["n"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
