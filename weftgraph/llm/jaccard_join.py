"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence matrix.

1. Texts become sets of hashed shingles; equal sets are one node (copies collapse before anything is paired).
2. Columns of the product: by the size-derived prefix bound two sets can only link if they share a shingle
   among their first n - ceil(t n) + 1 in one common order. Short columns (few nodes) use hash order. Nodes
   that meet in a long column are ordered anew among themselves, rarest shingle first; a node of which too
   few shingles occur in any other such node can link to none of them and leaves.
3. Every column links its nodes to one leader first. Components of the found links then rule out most of
   the rest: only pairs across components are still multiplied, so a group of copies costs its size, not
   the square, and no link between different components is lost.
4. The product accumulates overlaps block of columns by block of columns. The first block is the columns of
   the prefixes: a pair's overlap there is summed over the columns in which both have an entry, and a pair
   goes if it is below what its sizes ask of prefixes. The others are the two parts of the hash space, row by
   row of the pairs still open; after the first of them a pair goes if even a full match of what is left
   cannot reach the size-derived minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import Workspace, free_shuffles, only, python_stage, skew_safe_join

#: Nodes in a column from which on the column counts as long.
LONG = 16
#: Bits of the hash space that select the first column block: a quarter of all shingles.
HEAD_BITS = 2
#: The prefix is longer by a part of itself, so that one shared line does not make a candidate.
EXTRA = 3
#: Nodes whose ids are broadcast to find their texts; with more, texts are joined by id.
MAX_BROADCAST = 500_000
CACHE_WORDS = 300_000


class Shingler:
    """Distinct 64-bit shingle hashes of a text, ascending as unsigned numbers."""

    def __init__(self, size: int):
        self.size, self.cache = size, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both ASCII only
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(h):
            return h
        if len(h) < self.size:  # the whole sequence, told apart from full shingles by its length
            out = np.array([len(h)], dtype=np.uint64)
            parts = [h[i : i + 1] for i in range(len(h))]
        else:
            n = len(h) - self.size + 1
            out, parts = np.zeros(n, dtype=np.uint64), [h[i : i + n] for i in range(self.size)]
        for part in parts:
            out = out * np.uint64(0x9E3779B97F4A7C15) + part
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def least_overlap(n: Column, percent: int) -> Column:
    """Shingles that a set of ``n`` must share at least with any set it links to: ceil(t n)."""
    return F.ceil(n * percent / 100).cast("int")


def prefix_length(n: int, percent: int) -> tuple[int, int]:
    """Length of a set's prefix, and how many shingles two linked sets share at least within their prefixes.

    n - ceil(t n) + 1 shingles hold one common shingle at least; each further shingle holds one more.
    """
    base = n + percent * -n // 100 + 1
    extra = max(1, base // EXTRA)
    return min(n, base + extra - 1), extra


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, node (128-bit hash of the set; null without shingles), prefix in hash order."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler.of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                _lists([s[: prefix_length(len(s), percent)[0]] if len(s) else s for s in sets]),
                # of the smallest set it may link to
                pa.array([prefix_length(-(percent * -len(s) // 100), percent)[1] if len(s) else 0 for s in sets], pa.int32()),
            ], names=["doc_id", "n", "node", "prefix", "least"])

    return docs.mapInArrow(run, "doc_id long, n long, node binary, prefix array<long>, least int")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, hash, text) -> node, n, head and tail (the set in two column blocks); texts of another set are left out."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            rows = [(node, s) for node, want, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
                    if xxhash.xxh3_128_digest((s := shingler.of(x.as_py())).tobytes()) == want]
            sets = [s for _, s in rows]
            cuts = [int(np.searchsorted(s, np.uint64(1 << (64 - HEAD_BITS)))) for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array([n for n, _ in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                _lists([s[:c] for s, c in zip(sets, cuts, strict=True)]), _lists([s[c:] for s, c in zip(sets, cuts, strict=True)]),
            ], names=["node", "n", "head", "tail"])

    return docs.mapInArrow(run, "node long, n int, head array<long>, tail array<long>")


def _product(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps in the first column block, the bound, then the other block."""
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"), F.size("head").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"), F.size("head").alias("cb"))
    first = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ha", "hb"))).filter(
        F.col("o") + F.least(F.col("na") - F.col("ca"), F.col("nb") - F.col("cb")) >= need).select("a", "b", "na", "nb", "o")
    rest = first.join(sets.select(F.col("node").alias("a"), F.col("tail").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tail").alias("tb")), "b")
    shared = F.col("o") + F.size(F.array_intersect("ta", "tb"))
    return rest.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Sets of ``size``-word shingles link if their Jaccard similarity is at least ``percent`` %. Texts of fewer
    words are one shingle; texts without words, and null, link with nothing. Ids need not be unique (rows are
    numbered then, so that no text meets the nodes of another row with its id); rows with a null id link others
    but name no component. Repeated rows and copies are one node, and of pairs that tie none is left out. A text
    of any length is one set, held by one worker at a time. An empty table gives an empty result. Other columns
    are not read.
    """
    space = Workspace(docs.sparkSession, "jaccard")
    slim = only(docs, id, text).toDF("doc_id", "text")
    found = _components(slim, space, size, percent)
    return _by_number(slim, space, size, percent) if found is None else found


def _by_number(slim: DataFrame, space: Workspace, size: int, percent: int) -> DataFrame:
    """The components of rows that are told apart by a number, named by the least id in them."""
    numbered = space.save(slim.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("_id"), "text"), "numbered")
    found = _components(numbered.select("doc_id", "text"), Workspace(slim.sparkSession, "jaccard-numbered"), size, percent)
    named = space.save(numbered.select("doc_id", "_id").join(found, "doc_id").select("_id", "n_shingles", F.col("component_id").alias("_part")), "named-rows")
    parts = space.save(named.groupBy("_part").agg(F.min("_id").alias("component_id"), F.count(F.lit(1)).alias("_rows")), "parts")
    return skew_safe_join(named, parts, "_part", "_rows", named.count()).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def _components(slim: DataFrame, space: Workspace, size: int, percent: int) -> DataFrame | None:
    """doc_id, n_shingles, component_id of rows with ids of their own; None where an id is null or stands twice."""
    rows = space.save(_signed(slim, size, percent), "rows")
    slim_rows = space.save(rows.select("doc_id", "n", F.col("node").alias("hash")), "slim")
    total = slim_rows.count()
    ids = slim_rows.agg(F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("unique")).first()
    if not ids["known"] == ids["unique"] == total:
        space.drop("rows")
        return None
    one = rows.filter("node is not null").groupBy(F.col("node").alias("hash")).agg(F.min(F.struct("n", "least", "prefix")).alias("s"), F.min("doc_id").alias("doc_id"))
    nodes = space.save(one.select(F.monotonically_increasing_id().alias("node"), "hash", F.col("s.n").cast("int").alias("n"), F.col("s.least").alias("least"), F.col("s.prefix").alias("prefix"), "doc_id"), "nodes")
    space.drop("rows")
    names = space.save(nodes.select("node", "hash"), "names")
    links = _links(slim, nodes, space, size, percent)
    roots = components(links, space, "roots")
    known = names.join(roots, "node", "left").select("hash", F.coalesce("root", "node").alias("root"))
    sizes = slim_rows.filter("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_least"))
    placed = sizes.join(known, "hash")
    whole = placed.groupBy("root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    # the nodes of a large component find its name by broadcast
    named = skew_safe_join(placed.select("hash", "root", "_n"), space.save(whole, "whole"), "root", "_nodes", total).select("hash", "_n", "component_id")
    linked = skew_safe_join(slim_rows.filter("hash is not null"), space.save(named, "named"), "hash", "_n", total)
    alone = slim_rows.filter("hash is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _links(slim: DataFrame, nodes: DataFrame, space: Workspace, size: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that connect whatever links; no two rows share an id."""
    spark = slim.sparkSession
    columns = space.save(nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "columns")
    free_shuffles(spark)
    entries = nodes.select("node", "n", "least", F.posexplode("prefix").alias("at", "token")).join(columns, "token")
    every = space.save(entries.select("token", "c", "node", "n", "least", "at"), "entries")
    free_shuffles(spark)
    # A node must meet others in as many columns as two linked sets share within their prefixes.
    enough = every.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("least").alias("least")).filter("k >= least").select("node")
    short = space.save(every.join(enough, "node", "left_semi").select("token", "c", "node", "n", "least", "at"), "short")
    involved = space.save(nodes.join(enough, "node", "left_semi").select("node", "hash", "doc_id"), "involved")
    for name in ("entries", "columns", "nodes"):  # their prefixes are in the short columns now
        space.drop(name)
    if involved.count() <= MAX_BROADCAST:
        involved = F.broadcast(involved)
    chosen = slim.withColumnRenamed("doc_id", "_id").join(involved, F.col("_id") == F.col("doc_id")).select("node", "hash", "text")
    sets = space.save(_sets(chosen, size), "sets")
    free_shuffles(spark)

    # Nodes of long columns among themselves: rarest shingle first, those that share too little leave.
    crowd = short.filter(F.col("c") >= LONG).select("node").distinct()
    tokens = sets.join(crowd, "node", "left_semi").select("node", "n", F.explode(F.concat("head", "tail")).alias("token"))
    df = space.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "df")
    shared = tokens.join(df, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    alive = shared.withColumn("m", F.size("t")).filter(F.col("m") >= least_overlap(F.col("n"), percent))
    kept = F.slice("t", 1, F.greatest(F.col("m") - least_overlap(F.col("n"), percent) + 1, F.lit(0)))
    long = space.save(alive.select("node", "n", "m", F.posexplode(kept).alias("at", "x")).select(F.col("x.token").alias("token"), "node", "n", "m", "at"), "long")
    # Two linked sets that share no long column share ``least`` short ones; of those that share a long one, one column of the new order.
    entries = short.filter(F.col("c") < LONG).select(F.lit(0).alias("part"), "token", "node", "n", F.col("n").alias("m"), "least", "at").unionByName(
        long.select(F.lit(1).alias("part"), "token", "node", "n", "m", F.lit(1).alias("least"), "at"))

    # One leader a column: the node with the fewest shingles of its own.
    leaders = entries.groupBy("part", "token").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), F.col("node"))).alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("part", "token", F.col("l.node").alias("leader"))
    ordered = (F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    star = space.save(entries.join(leaders, ["part", "token"]).filter("node <> leader").select(*ordered).distinct(), "star")
    first = space.save(_product(star, sets, percent), "links-1")
    roots = components(first, space, "first")
    free_shuffles(spark)

    # What is left: pairs of one column across components, by the bounds on sizes, shared shingles and places.
    placed = space.save(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("part", "token").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("part", "token")
    open_ = space.save(placed.join(mixed, ["part", "token"]), "open")
    for name in ("placed", "short", "long", "df"):
        space.drop(name)
    a, b = (open_.select("part", "token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "m", "least", "at", "root"))) for s in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    pairs = a.join(b, ["part", "token"]).filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
        & (F.least("m_a", "m_b") >= need)
        # at the k-th of the shared columns k - 1 are behind, the rest must still fit; the first ``least`` of them are counted
        & (F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b")) + F.least("least_a", "least_b") - 1 >= need)
    ).groupBy("part", F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("o"), F.min(F.least("least_a", "least_b")).alias("least")).filter(
        F.col("o") >= F.col("least")).select("a", "b").distinct()
    left = space.save(pairs.join(star, ["a", "b"], "left_anti"), "left")
    second = space.save(_product(left, sets, percent), "links-2")
    return first.unionByName(second)


def jaccard_table(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, size=4, percent=85)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per component, the one with the least id, and all rows that link with nothing; all columns stay, whatever their names.

    Null, empty and wordless texts link with nothing and stay. Where ids repeat or are null, rows are numbered
    first, and of rows with the least id that with the least number stays; a null id comes last. An empty
    table gives an empty result.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    ids = docs.select(F.col(f"`{id}`").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.count_distinct("id").alias("ids")).first()
    if ids["n"] == ids["ids"] == ids["known"]:
        found = jaccard_components(docs, size, percent, text, id).filter("doc_id <> component_id").select(F.col("doc_id").alias(id))
        return docs.join(found, id, "left_anti").select(*every)
    space = Workspace(docs.sparkSession, "one-of-each")
    numbered = space.save(docs.select(F.struct(*every).alias("_doc"), F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_row")), "numbered")
    found = jaccard_components(numbered, size, percent, "_text", "_row").select(F.col("doc_id").alias("_row"), "component_id")
    named = numbered.select("_row", F.col("_id").isNull().alias("_null"), "_id").join(found, "_row")
    kept = named.groupBy("component_id").agg(F.min(F.struct("_null", "_id", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    return numbered.join(kept, "_row", "left_semi").select("_doc.*")
