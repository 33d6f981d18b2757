"""Scoring of set-valued answers, latency percentiles and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import match_keys
from ..sources.staging import Staging


def score_answers(answers: DataFrame, truth: DataFrame, questions: DataFrame, acceptable: DataFrame | None = None) -> DataFrame:
    """Per question: tp, fp, fn, hallucinations, precision, recall, f1 (four digits).

    answers(qid, item), truth(qid, pos, item, aliases[]), questions(qid, entity), acceptable(qid, item).
    An answer counts for the first truth it shares a key with; several answers to one truth are one hit.
    """
    kind = questions.select("qid", "entity")
    said = answers.filter(F.trim("item") != "").withColumn("_row", F.monotonically_increasing_id()).join(kind, "qid").select("qid", "_row", F.explode(match_keys("item", F.col("entity"))).alias("key"), F.element_at(match_keys("item", F.col("entity")), 1).alias("norm"))
    names = F.concat(F.array("item"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = truth.join(kind, "qid").select("qid", "pos", "entity", F.explode(names).alias("n")).select("qid", "pos", F.explode(match_keys("n", F.col("entity"))).alias("key")).distinct()
    hit = said.join(known, ["qid", "key"], "left").groupBy("qid", "_row").agg(F.min("pos").alias("pos"), F.first("norm").alias("norm"))
    if acceptable is not None:
        fine = acceptable.join(kind, "qid").select("qid", F.explode(match_keys("item", F.col("entity"))).alias("norm")).distinct().withColumn("_ok", F.lit(True))
        hit = hit.join(fine, ["qid", "norm"], "left")
    else:
        hit = hit.withColumn("_ok", F.lit(None).cast("boolean"))
    miss = F.col("pos").isNull()
    got = hit.groupBy("qid").agg(
        F.count_distinct("pos").alias("tp"), F.count_if(miss).alias("fp"), F.count_distinct(F.when(miss, F.col("norm"))).alias("_wrong"),
        F.count_if(miss & F.col("_ok").isNull()).alias("hallucinations"), F.count(F.lit(1)).alias("_said"))
    want = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("_want"))
    rows = kind.select("qid").join(got, "qid", "left").join(want, "qid", "left").na.fill(0)
    distinct = F.col("tp") + F.col("_wrong")
    precision = F.when(distinct > 0, F.col("tp") / distinct).when(F.col("_want") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("_want") > 0, F.col("tp") / F.col("_want")).when(F.col("_said") == 0, 1.0).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("qid", "tp", "fp", (F.col("_want") - F.col("tp")).alias("fn"), "hallucinations", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def summarise(runs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Means by group; a run without an answer (``scored`` false) counts as zero."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.when(F.col("scored"), F.col(m)).otherwise(0.0)), 4).alias(m) for m in measures))


#: Ranges of values per group in which ranks are counted before values are looked at.
SLICES = 256


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50 is the median; p95 and p99 the element at rank int(n p), clamped; exact.

    Values are cut into ranges at approximate quantiles of their group; ranks are first placed by the counts of
    the ranges, then only the ranges that hold a wanted rank are counted value by value, so no group is gathered.
    """
    from pyspark.sql import Window

    known = rows.filter(F.col(value).isNotNull()).select(by, value)
    cuts = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max"), F.array_distinct(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 10_000)).alias("_cuts"))
    staging = Staging(rows.sparkSession, "latency")
    cuts = staging.save(cuts, "cuts")  # a row per group, read four times below
    last = F.col("n") - 1
    ranks = {"lo": F.floor(last / 2), "hi": F.ceil(last / 2), "p95": F.least(F.floor(F.col("n") * 0.95), last), "p99": F.least(F.floor(F.col("n") * 0.99), last)}
    same = F.col(by).eqNullSafe(F.col(f"_{by}"))
    known = staging.save(known.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c")), "values")
    at = known.join(F.broadcast(cuts.select(F.col(by).alias(f"_{by}"), "_cuts")), same) if cuts.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else known.join(cuts.select(F.col(by).alias(f"_{by}"), "_cuts"), same)
    sliced = at.select(by, value, "_c", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_s"))
    counts = sliced.groupBy(by, "_s").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most SLICES rows a group
    placed = counts.withColumn("_before", before).join(cuts.select(F.col(by).alias(f"_{by}"), "n", "max"), same).drop(f"_{by}")
    wanted = placed.select(by, "_s", "_before", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), (v - F.col("_before")).alias("rank")) for k, v in ranks.items()))).alias("_w"), "_n").filter("_w.rank >= 0 and _w.rank < _n")
    wanted = wanted.select(F.col(by).alias(f"_{by}"), F.col("_s").alias("_ws"), "_w.what", "_w.rank")
    inside = sliced.withColumn("_hi", F.sum("_c").over(Window.partitionBy(by, "_s").orderBy(value)))
    found = inside.join(wanted, same & (F.col("_s") == F.col("_ws"))).filter(F.col("_hi") > F.col("rank")).groupBy(by, "what").agg(F.min(value).alias("v"))
    one = lambda k: F.max(F.when(F.col("what") == k, F.col("v")))
    stats = found.groupBy(by).agg(((one("lo") + one("hi")) / 2).alias("p50"), one("p95").alias("p95"), one("p99").alias("p99"))
    return stats.join(cuts.select(F.col(by).alias(f"_{by}"), "n", "max"), same).select(by, "n", "p50", "p95", "p99", "max")


#: Groups whose cuts are broadcast.
MAX_GROUPS = 10_000


def shares(rows: DataFrame, key: str, min_count: int = 2, big: int = 20, min_share: float = 0.05) -> DataFrame:
    """Values of ``key`` with at least ``min_count`` rows that are many (``big``) or hold ``min_share`` of all, most first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).filter((F.col("n") >= min_count) & ((F.col("n") >= big) | (F.col("n") >= min_share * F.col("_t")))).select(key, "n").orderBy(F.desc("n"), key)


def vocabulary(paths: DataFrame, path: str, limit: int = 25) -> DataFrame:
    """Most frequent directory names."""
    parts = F.split(path, "/")
    names = paths.select(F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("name")).filter("name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def final_answers(texts: DataFrame) -> DataFrame:
    """texts(id, text) -> (id, answer): the last fenced JSON block that is an object with ``answer``; null without one."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    made = F.filter(F.transform(blocks, lambda b: F.when(F.get_json_object(b, "$.answer").isNotNull(), F.regexp_replace(b, r"^\s+|\s+$", ""))), lambda b: b.isNotNull())
    return texts.select("id", F.try_element_at(made, F.lit(-1)).alias("answer"))


def usage(events: DataFrame) -> DataFrame:
    """events(id, pos, line), a JSON object a line -> per run its last result, tokens by kind, tool calls in order.

    Tokens are those the last result states by model, not a sum over messages, which repeat; lines that do not
    parse say nothing.
    """
    kinds = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_input_tokens": "cacheReadInputTokens", "cache_creation_input_tokens": "cacheCreationInputTokens"}
    runs = events.select("id").distinct()
    last = events.filter(F.get_json_object("line", "$.type") == "result").groupBy("id").agg(F.max_by("line", "pos").alias("result"))
    models = F.from_json(F.get_json_object("result", "$.modelUsage"), "map<string, struct<" + ", ".join(f"{k}: long" for k in kinds.values()) + ">>")
    tools = events.select("id", "pos", F.posexplode(F.from_json(F.get_json_object("line", "$.message.content"), "array<struct<type: string, name: string>>")).alias("at", "c")).filter("c.type = 'tool_use'")
    called = tools.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "c.name"))), lambda x: x["name"]).alias("tools"))
    total = lambda k: F.aggregate(F.coalesce(F.map_values("_m"), F.array()), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v[k], F.lit(0)))
    return runs.join(last, "id", "left").join(called, "id", "left").withColumn("_m", models).select("id", "result", *(total(v).alias(k) for k, v in kinds.items()), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))


class Steps:
    """Wall time of the driver's named steps: ``with steps("scan"): ...``; ``totals`` sums by name, longest first."""

    def __init__(self):
        self.spent: dict[str, float] = {}

    def __call__(self, name: str):
        from contextlib import contextmanager

        @contextmanager
        def timed():
            import time

            began = time.perf_counter()
            try:
                yield
            finally:
                self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - began

        return timed()

    def totals(self) -> list[tuple[str, float, float]]:
        """(name, seconds, share of all)."""
        whole = sum(self.spent.values()) or 1.0
        return [(k, v, v / whole) for k, v in sorted(self.spent.items(), key=lambda x: (-x[1], x[0]))]
