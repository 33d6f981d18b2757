"""Audit of how document filters interact: what each takes alone, behind others, and on average over all orders.

A relational word pipeline counts words: texts are dealt out by row, words exploded, aggregated by (row, word)
and then by row for totals and distincts; both aggregations use the one exchange of the texts. Beside it stands
a slim table of the flags that need no words, whose rows meet the word counts by an outer join. Each row then
fails a subset of the five filters, and 32 conditional counts per part say all about any order: every figure
of the report is a sum of some of the 32.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import SPACE, Workspace, only

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Fixed values of the filters: least words; distinct words per 100; capital letters per 100 code points; symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: What a row is met by: its id and 128 bits of its text, on which every flag depends.
KEY = ["_id", "_h", "_g"]


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce("_text", F.lit(""))
    return docs.select("_id", F.xxhash64(body).alias("_h"), F.xxhash64(F.lit(1), body).alias("_g"), body.alias("_body"), F.coalesce("_part", F.lit("")).alias("part"))


def word_counts(docs: DataFrame) -> DataFrame:
    """Per id and text that has a word: n_words, n_distinct.

    Every row has a number of its own, by which the texts are dealt out, so neither copies nor an id that is
    often repeated meet in one task, and the words of a text need no exchange of their own.
    """
    dealt = _keyed(docs).drop("part").withColumn("_row", F.monotonically_increasing_id()).repartition("_row")
    words = dealt.select("_row", *KEY, F.explode(F.split("_body", f"[{SPACE}]+")).alias("_word")).filter("_word <> ''")
    per_word = words.groupBy("_row", *KEY, "_word").agg(F.count(F.lit(1)).alias("_n"))
    per_row = per_word.groupBy("_row", *KEY).agg(F.sum("_n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    return per_row.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failed_filters(docs: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """Per document: doc_id, part, fails (the filters it fails as bits, A the lowest).

    Whether a smaller id has the same text is looked up by (text, id), a key of few rows in a group of
    copies of any size: only the row of the least id finds itself. A null id is no smaller one and has none.
    """
    slim = only(docs, id, text, part).toDF("_id", "_text", "_part")
    keyed, space = _keyed(slim), Workspace(docs.sparkSession, "filter-audit")
    capitals = F.length(F.regexp_replace("_body", "[^A-Z]+", ""))
    other = space.save(keyed.select(
        *KEY, "part", F.unhex(F.sha2("_body", 256)).alias("_digest"),
        (100 * capitals > MAX_CAPITALS * F.length("_body")).alias("_c"), F.col("_body").rlike(SYMBOLS).alias("_d"),
    ), "flags")
    first = other.filter("_id is not null").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    counted = word_counts(slim).toDF(*(f"w{k}" for k in KEY), "n_words", "n_distinct")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"w{k}"))
    met = other.join(counted, same, "left").join(first, ["_digest", "_id"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    flags = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, F.col("_c"), F.col("_d"), F.col("_id").isNotNull() & F.col("_first").isNull()]
    return met.select(F.col("_id").alias("doc_id"), "part", sum((f.cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0)).alias("fails"))


def subset_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part: arrays rows, good, toxic of 32 conditional counts, by the subset of filters that a document fails.

    Of repeated labels the highest counts; labels without an id belong to no document.
    """
    known = only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"), F.max("toxic").alias("_toxic"))
    rows = failed.join(known, "doc_id", "left")
    kinds = {"rows": F.lit(True), "good": F.col("_good") == 1, "toxic": F.col("_toxic") == 1}
    wide = rows.groupBy("part").agg(*(F.count_if((F.col("fails") == s) & when).alias(f"{k}{s}") for k, when in kinds.items() for s in range(SUBSETS)))
    return wide.select("part", *(F.array(*(f"{k}{s}" for s in range(SUBSETS))).alias(k) for k in kinds))


def _summed(counts: str, chosen) -> Column:
    """Sum of the counts of the subsets for which ``chosen`` holds."""
    return F.aggregate(F.transform(counts, lambda n, s: F.when(chosen(s), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)


def interactions(counts: DataFrame) -> DataFrame:
    """The report of ``subset_counts``: per part 120 orders of five steps, zeros included."""
    orders = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("_at", "_letter"))
    bit_of = lambda letter: F.get(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.instr(F.lit(FILTERS), letter) - 1)
    earlier = F.aggregate(F.split("filter_order", ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("bits")), lambda s, x: F.struct(
        (s["i"] + 1).alias("i"), F.when(s["i"] < F.col("_at"), s["bits"].bitwiseOR(bit_of(x))).otherwise(s["bits"]).alias("bits")), lambda s: s["bits"])
    at = steps.withColumn("_bit", bit_of(F.col("_letter"))).withColumn("_before", earlier)
    bit, before = F.col("_bit"), F.col("_before")
    fails, gone = (lambda s: s.bitwiseAND(bit) != 0), (lambda s: s.bitwiseAND(before) != 0)
    # Over all orders a document that fails k filters is removed by each of them equally often.
    share = F.aggregate(F.transform("rows", lambda n, s: F.when(fails(s), n * F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(s))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    return at.select(
        "part", "filter_order", (F.col("_at") + 1).cast("int").alias("step"),
        _summed("rows", lambda s: ~fails(s) & ~gone(s)).alias("kept"), _summed("rows", lambda s: fails(s) & ~gone(s)).alias("removed"),
        _summed("rows", lambda s: fails(s) & gone(s)).alias("redundant"), F.element_at("rows", bit + 1).alias("unique_fails"),
        _summed("good", lambda s: fails(s) & ~gone(s)).alias("good_lost"), _summed("toxic", lambda s: fails(s) & ~gone(s)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty and fails A; a null part is that of the empty name. A null id has no labels and is
    nobody's copy; rows that share id and text are each counted and no copies of one another. A text of any
    length is counted whole, its words by aggregation. Documents without labels count as neither good nor
    toxic. An empty table gives an empty result. Other columns are not read.
    """
    return interactions(subset_counts(failed_filters(docs, text, id, part), labels))


#: DuckDB SQL of the registered query.
SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select rid, len(l) as n, len(list_distinct(l)) as u from (select rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as l from d)),
e as (select t, min(doc_id) as least from d group by t),
lab as (select doc_id, max(quality) as q, max(toxic) as x from labels where doc_id is not null group by doc_id),
f as (
  select part, q, x, cast(n < {MIN_WORDS} as int) + 2 * cast(100 * u < {MIN_DISTINCT} * n as int)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t) as int)
    + 8 * cast(regexp_matches(t, '{SYMBOLS}') as int) + 16 * cast(coalesce(doc_id > least, false) as int) as fails
  from d join w using (rid) join e using (t) left join lab using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (where q = 1) as good, count(*) filter (where x = 1) as toxic from f group by part, fails),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as o from letter a, letter b, letter c, letter d, letter e
  where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
steps as (
  select o, s, 1 << (ascii(o[s]) - 65) as bit, list_sum([0] || list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
report as (
  select part, o as filter_order, s as step, bit,
    sum(n) filter (where fails & bit = 0 and fails & cast(before as int) = 0) as kept,
    sum(n) filter (where fails & bit <> 0 and fails & cast(before as int) = 0) as removed,
    sum(n) filter (where fails & bit <> 0 and fails & cast(before as int) <> 0) as redundant,
    sum(n) filter (where fails = bit) as unique_fails,
    sum(good) filter (where fails & bit <> 0 and fails & cast(before as int) = 0) as good_lost,
    sum(toxic) filter (where fails & bit <> 0 and fails & cast(before as int) = 0) as toxic_lost
  from c, steps group by part, o, s, bit)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) as shapley
from report"""
