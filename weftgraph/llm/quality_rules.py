"""Document quality rules with host-level verdicts. Main path: DataFrame and SQL functions only.

Rule failures are counted per host, each host's failure rate is shrunk towards the empirical beta prior of
all hosts (method of moments), and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import SPACE, Workspace, only, skew_safe_join

#: A document fails with fewer words, or with more than this share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected if its shrunk failure rate exceeds this: most of its documents are expected to fail.
MAX_HOST_RATE = 0.5
#: Rejected hosts that are broadcast.
MAX_BROADCAST = 20_000


def words_of(text: Column) -> Column:
    """Runs of characters that are no ASCII white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _windows(words: Column, of) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    full = F.transform(starts, lambda i: of(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) >= WINDOW, full)


def _ranked(words: Column) -> Column:
    """All windows with their places, equal windows next to each other."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW))).alias("w"), i.alias("i"))))


def _again(ranked: Column) -> Column:
    """Ascending places of the windows that occur twice or more; ``ranked`` must be a computed column."""
    same = F.transform(ranked, lambda x, i: F.when(
        (x["w"] == F.get(ranked, i - 1)["w"]) | (x["w"] == F.get(ranked, i + 1)["w"]), x["i"]))
    return F.sort_array(F.filter(same, lambda x: x.isNotNull()))


def document_rules(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed as ``_q`` fields.

    ``_text`` is the text column (null: no words). Whether any window repeats is decided on 64-bit hashes,
    which cannot miss one; only documents with a repeat are then counted, on the words themselves.
    """
    words = docs.withColumn("_words", words_of(F.coalesce("_text", F.lit(""))))
    hashed = words.withColumn("_hashes", _windows(F.col("_words"), F.xxhash64))
    repeats = F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False))
    flagged = hashed.withColumn("_again", repeats).drop("_hashes")
    ranked = flagged.withColumn("_ranked", F.when(F.col("_again"), _ranked(F.col("_words"))))
    places = ranked.withColumn("_places", _again(F.col("_ranked"))).drop("_ranked")
    gaps = F.zip_with(F.slice("_places", 2, F.greatest(F.size("_places") - 1, F.lit(0))), F.slice("_places", 1, F.greatest(F.size("_places") - 1, F.lit(0))),
                      lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("_places") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = places.withColumn("_lines", lines)
    full = counted.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", "")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return full.withColumn("base_failed", failed)


def host_rates(rows: DataFrame) -> DataFrame:
    """Per host: n, failed, rate shrunk by the prior beta(a, b) fitted to the hosts' rates by moments.

    With fewer than two hosts or no spread between them the prior is that of one document at the mean rate.
    """
    hosts = rows.filter("_host is not null").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    raw = hosts.withColumn("r", F.col("failed") / F.col("n"))
    m, v = F.col("m"), F.col("v")
    strength = F.when((v > 0) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(1.0)
    prior = raw.agg(F.avg("r").alias("m"), F.var_pop("r").alias("v")).select(m, strength.alias("k"))
    return hosts.crossJoin(F.broadcast(prior)).select("_host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"))


def _judged(rows: DataFrame, max_rate: float, space: Workspace) -> DataFrame:
    """Add ``kept``. Rejected hosts are few as a rule: up to MAX_BROADCAST of them are broadcast and no row moves.

    With more, rows of the at most 1000 hosts that hold a thousandth of all rows each are decided by a
    broadcast of those hosts, all others by a join on the host.
    """
    hosts = space.save(host_rates(rows).select("_host", "n", (F.col("rate") > max_rate).alias("_bad")), "hosts")
    bad = hosts.filter("_bad").select("_host", "_bad")
    if bad.count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(bad), "_host", "left")
    else:
        known, unknown = rows.filter("_host is not null"), rows.filter("_host is null").withColumn("_bad", F.lit(False))
        joined = skew_safe_join(known, hosts, "_host", "n", rows.count()).drop("n").unionByName(unknown)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("_bad", F.lit(False))).drop("_bad")


def quality_rules(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: doc_id, the rule counts, base_failed, kept.

    A document is kept if it passes the rules itself and its host is not rejected. Null text has no words and
    fails; a null host is no host, its documents are judged alone. Ties cannot arise; repeated rows count
    as often as they stand there. A text of any length is judged whole, in the JVM. An empty table gives an
    empty result. Other columns are not read.
    """
    slim = only(docs, id, text, host).toDF("doc_id", "_text", "_host")
    space = Workspace(docs.sparkSession, "quality")
    return _judged(space.save(document_rules(slim).drop("_text"), "rows"), max_rate, space).drop("_host")


def keep_quality(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that are kept, with their columns only, whatever their names; texts are read once for the rules.

    What holds for nulls, empty and very long texts, repeated rows and an empty table is as in ``quality_rules``.
    """
    has_host = F.col(f"`{host}`") if host in docs.columns else F.lit(None).cast("string")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text}`").alias("_text"), has_host.alias("_host"))
    rows = document_rules(inner).select("_doc", "_host", "base_failed")
    space = Workspace(docs.sparkSession, "quality")
    return _judged(space.save(rows, "rows"), max_rate, space).filter("kept").select("_doc.*")


#: DuckDB SQL of ``quality_rules`` over the table {docs}, up to the verdicts, for the query and the pipeline.
SQL = f"""
q_words as (
  select doc_id, source, coalesce(text, '') as body, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, row_number() over () as rid
  from {{docs}}),
q_win as (select rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from q_words, lateral (select unnest(range(1, len(w) - {WINDOW - 2})) as i)),
q_again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from q_win) where c > 1),
q_cover as (select rid, cast(sum(least(coalesce(lead_i - i, {WINDOW}), {WINDOW})) as bigint) as n from (select rid, i, lead(i) over (partition by rid order by i) as lead_i from q_again) group by rid),
q_lines as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(body, chr(10))) as l from q_words) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
q_rules as (
  select q_words.rid, doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(q_lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(q_cover.n, 0) as bigint) as n_repeat_words
  from q_words left join q_cover using (rid) left join q_lines using (rid)),
q_failed as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from q_rules),
q_hosts as (select source, count(*) as n, count(*) filter (where base_failed) as failed from q_failed where source is not null group by source),
q_prior as (select m, case when v > 0 and m * (1 - m) > v then m * (1 - m) / v - 1 else 1.0 end as k from (select avg(failed / n) as m, var_pop(failed / n) as v from q_hosts)),
q_bad as (select source from q_hosts, q_prior where (failed + m * k) / (n + k) > {MAX_HOST_RATE}),
q_judged as (select *, not base_failed and (source is null or source not in (select source from q_bad)) as kept from q_failed)
"""
