"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put into a fixed pseudo-random order and cut into blocks. A source's target
decides its exact quota of block draws: whole passes over its blocks and a partial one, whose last block is
cut between documents. The quotas of all sources are split among the output shards by a binary tree of
multivariate hypergeometric draws; a shard takes the disjoint ranges of permuted blocks that it drew and
shuffles them locally by a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import words_of
from .work import Workspace, only

WEIGHTS, MAX_REPEAT = (5.0, 2.0, 1.0), 3.0
#: Output shards at least, and words of a shard at most where their number is left open.
SHARDS, SHARD_WORDS, SEED = 64, 16_000_000, 17
#: Documents and words of a block: a source has as many blocks as keep both, so that every shard finds enough of them.
BLOCK_DOCS, BLOCK_WORDS = 256, 1_000_000
#: Blocks whose words are summed as one before those of a single block are looked at.
COARSE_BITS = 12
HASH_BITS = 40
#: Sources whose dimension rows are broadcast; with more they are joined by key.
MAX_BROADCAST = 20_000


def targets(sizes: list[int], weights: list[float], max_repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight; a target stops at ``max_repeat`` times its size, the excess is reshared."""
    total, open_, fixed = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        over = [i for i in open_ if share[i] > max_repeat * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        for i in over:
            fixed[i] = max_repeat * sizes[i]
            open_.remove(i)
    return [fixed[i] for i in range(len(sizes))]


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Block draws by shard and source: column sums are the quotas, row sums differ by one at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, n = (lo + hi) // 2, int(have.sum())
        take = n * (mid - lo) // (hi - lo)
        left = _hypergeometric(rng, have, take)
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source by source, for counts of any size."""
    out, left = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have):
        n, rest = int(n), left - int(n)
        if left <= 10**9:
            k = int(rng.hypergeometric(n, rest, take)) if take and n else 0
        else:  # beyond the sampler's range the normal limit, within the exact bounds
            mean = take * n / left
            sd = (mean * (1 - n / left) * (left - take) / max(1, left - 1)) ** 0.5
            k = round(rng.normal(mean, sd))
        out[i] = k = min(max(k, take - rest, 0), n, take)
        take, left = take - k, rest
    return out


def cut_block(docs: list[tuple[int, int]], room: int) -> tuple[int, list[int]]:
    """Of one block's (place, size): the last place of the run that fits ``room``, and later ones that fill it up."""
    totals: dict[int, int] = {}
    for place, size in docs:
        totals[place] = totals.get(place, 0) + size
    cut, rest = min(totals) - 1, sorted(totals.items())
    while rest and rest[0][1] <= room:
        cut, room, rest = rest[0][0], room - rest[0][1], rest[1:]
    extra = []
    for place, size in sorted(rest, key=lambda x: (-x[1], x[0])):
        if size <= room and size:
            extra.append(place)
            room -= size
    if smaller := [x for x in rest if x[0] not in extra and x[1] < 2 * room]:  # rather over than further under
        extra.append(min(smaller, key=lambda x: (abs(x[1] - room), x[0]))[0])
    return cut, extra


def _dimension(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row per source: broadcast up to MAX_BROADCAST of them, so that no document moves to meet its source."""
    made = docs.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= MAX_BROADCAST else made


def _crossing(placed: DataFrame, key: list[str], at: str, past) -> DataFrame:
    """Per source the ``at`` in which the running words, ``past`` included, reach ``_mix_rest``, and those done before it."""
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*key, "_mix_rest", at, past.alias("past")).agg(F.sum("_mix_size").alias("w")).withColumn("done", F.coalesce(F.sum("w").over(before), F.lit(0)) + F.col("past"))
    return sums.filter("done < _mix_rest and done + w >= _mix_rest").select(*key, at, "done")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, shards: int | None = SHARDS, seed: int = SEED,
        text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document as struct ``_doc``, with size, source_size, target and ``draws`` (prefixed ``_mix_``): one struct (epoch, shard, place) per copy taken.

    Size is the number of words (null text: 0). Sources are weighed in code point order, null last, by
    ``weights`` repeating. The order of documents is a hash of id and text, so reruns agree; rows that repeat
    another in both are taken together with it. Null and empty texts have no words: they cost their source
    nothing and come as often as its whole passes and the place of their hash have it. Texts of any length are
    drawn whole. An empty table gives an empty result. The tables collected have a row per source and a row
    per document of one block per source.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.crc32(body.cast("binary"))), 64 - HASH_BITS)
    name = F.col(f"`{source}`") if source in docs.columns else F.lit(None).cast("string")
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    added = docs.select(doc.alias("_doc"), F.size(words_of(body)).cast("long").alias("_mix_size"), order.alias("_mix_order"), name.isNotNull().alias("_mix_known"), F.coalesce(name, F.lit("")).alias("_mix_source"))
    slim = space.save(added.select("_mix_known", "_mix_source", "_mix_size", "_mix_order"), "slim")
    key = ["_mix_known", "_mix_source"]
    sources = sorted(slim.groupBy(*key).agg(F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (not r[0], r[1]))
    shards = shards or max(SHARDS, -(-sum(r["words"] for r in sources) // SHARD_WORDS))
    goal = targets([r["words"] for r in sources], [weights[i % len(weights)] for i in range(len(sources))], max_repeat)
    plan = []
    for r, t in zip(sources, goal, strict=True):
        epochs = int(t // r["words"]) if r["words"] else 0
        blocks = max(1, -(-r["n"] // BLOCK_DOCS), -(-r["words"] // BLOCK_WORDS))
        plan.append((r[0], r[1], r["words"], float(t), epochs, round(t - epochs * r["words"]), blocks))
    dims = _dimension(docs, plan, "_mix_known boolean, _mix_source string, _mix_source_size long, _mix_target double, _mix_epochs int, _mix_rest long, _mix_blocks long")
    block = F.shiftright(F.col("_mix_order") * F.col("_mix_blocks"), HASH_BITS).alias("_mix_block")

    # The block of each source in which the partial pass ends: first among runs of blocks, then among the blocks of one run.
    placed = slim.join(dims, key).select(*key, "_mix_size", "_mix_order", "_mix_rest", block).withColumn("_mix_run", F.shiftright("_mix_block", COARSE_BITS))
    run = _crossing(placed, key, "_mix_run", F.lit(0)).withColumnRenamed("done", "_mix_past")
    edge = _crossing(placed.join(run, [*key, "_mix_run"]), key, "_mix_block", F.col("_mix_past"))
    edge_docs: dict[tuple, list] = {}
    for r in placed.join(edge, [*key, "_mix_block"]).select(*key, "_mix_block", "done", "_mix_order", "_mix_size").collect():
        edge_docs.setdefault((r[0], r[1]), []).append(r)

    quotas, last = [], []
    for known, src, _, _, epochs, rest, blocks in plan:
        found = edge_docs.get((known, src))
        if not found:  # no partial pass
            last.append((-1, [], 0))
        else:
            last.append((*cut_block([(r["_mix_order"], r["_mix_size"]) for r in found], rest - found[0]["done"]), found[0]["_mix_block"] + 1))
        quotas.append(epochs * blocks + last[-1][2])
    by_shard = split_quotas(quotas, shards, seed).cumsum(axis=0)
    full = [(*p, c, extra, [int(x) for x in by_shard[:, i]]) for i, (p, (c, extra, _)) in enumerate(zip(plan, last, strict=True))]
    dims = _dimension(docs, full, "_mix_known boolean, _mix_source string, _mix_source_size long, _mix_target double, _mix_epochs int, _mix_rest long, _mix_blocks long, _mix_cut long, _mix_extra array<long>, _mix_ends array<long>")
    joined = added.join(dims, key)
    partial = (F.col("_mix_order") <= F.col("_mix_cut")) | F.array_contains("_mix_extra", F.col("_mix_order"))
    draws = F.col("_mix_epochs") + partial.cast("int")
    struct = F.when(draws > 0, F.transform(F.sequence(F.lit(0), draws - 1), lambda e: F.struct(
        e.alias("epoch"),
        F.size(F.filter("_mix_ends", lambda x: x <= e * F.col("_mix_blocks") + F.col("_mix_at"))).alias("shard"),
        F.xxhash64(e, F.lit(seed), "_mix_order").alias("place"))))
    return joined.withColumn("_mix_at", block).withColumn("_mix_draws", F.coalesce(struct, F.array().cast("array<struct<epoch:int,shard:int,place:bigint>>"))).select(
        "_doc", "_mix_size", "_mix_source_size", "_mix_target", "_mix_draws")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), draws."""
    mixed = mix(only(docs, "doc_id", "text", "source"), **options)
    return mixed.select("_doc.doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
                        (F.col("_mix_size") * F.size("_mix_draws")).cast("long").alias("taken"), F.col("_mix_draws").alias("draws"))


def mixed_documents(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, with its own columns only.

    Rows come by output shard, each whole in one partition, and within a shard by place; there are as many
    shards as the words ask for, if not said. All columns stay,
    whatever their names. What holds for nulls, empty texts, repeated rows and an empty table is as in ``mix``.
    """
    drawn = mix(docs, shards=shards, **options).select("_doc", F.explode("_mix_draws").alias("_mix_draw"))
    return drawn.repartition("_mix_draw.shard").sortWithinPartitions("_mix_draw.shard", "_mix_draw.place", "_mix_draw.epoch").select("_doc.*")
