"""Spelling variants: words one edit apart, found by groups of words that share all but one place.

A word of L code points belongs to L wildcard groups, (position, prefix, suffix), and every word that differs
from it in that place is in the same group; it has up to L deletions, and every word that is one code point
shorter and near it equals one of them. A group keeps its size and its two leading words, so each member knows
how many near words it has there and which of them leads: no pair is ever formed. Words carry their rank (most
frequent first, then code-point order) and groups their polynomial hash of 124 bits, so a row is a few numbers
whatever the length of the word, and a word's keys cost time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Workspace, only, python_stage

#: Least code points and occurrences of a word; a form occurs at least so many times as often as the word.
MIN_LENGTH, MIN_COUNT, FORM_TIMES = 6, 5, 5
#: A run loses one code point if this divides its hash.
MISSPELT = 199
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fields of the polynomial hash: primes below 2 ** 31 and a base for each.
FIELDS = ((2147483647, 1103515245), (2147483629, 1220703125), (2147483587, 69621773), (2147483579, 1812433253))
#: Code points whose keys are made at once.
SLICE = 1 << 17
WILDCARD, DELETION, ITSELF = 0, 1, 2


def vocabulary(docs: DataFrame, text: str = "text", id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """word, n: the runs of letters of all texts, lower-cased in A-Z, of ``min_length`` code points and ``min_count`` occurrences or more.

    If ``misspelt`` divides the CRC-32 of "<id>:<run>" (a null id is empty there), the run counts without its
    code point at hash modulo length. Counts are combined before the exchange.
    """
    runs = only(docs, id, text).toDF("_id", "_text").select("_id", F.explode(F.regexp_extract_all("_text", F.lit(f"({RUN})"), F.lit(0))).alias("_run"))
    long_enough = runs.filter(F.length("_run") >= min_length)
    ascii_only = F.octet_length("_run") == F.length("_run")
    low = long_enough.select("_id", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)).alias("_low"))
    h = F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_low")).cast("binary"))
    hashed = low.withColumn("_h", h)
    at = (F.col("_h") % F.length("_low")).cast("int")
    cut = F.concat(F.substr("_low", F.lit(1), at), F.substr("_low", at + 2))
    words = hashed.select(F.when(F.col("_h") % misspelt == 0, cut).otherwise(F.col("_low")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(base, have, prime) % prime
        have += more
    return out


def keys(words: list[str], ranks: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """Arrays (k, a, b, role, rank): for each word its wildcard groups, its distinct deletions of ``shortest`` code points or more, itself.

    k is twice the length of what is hashed, one more for whole words, so that groups of one kind and length
    meet. A wildcard leaves its place out of the sum, which tells its position; of equal neighbours only the
    first is deleted, as the others give the same word.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - begin[owner]
    deleted = ((place == 0) | (points != np.concatenate([[-1], points[:-1]]))) & (sizes[owner] > shortest)
    longest = int(sizes.max(initial=0))
    found = []
    for prime, base in FIELDS:
        term = points * _powers(base, prime, longest)[place] % prime
        past = np.cumsum(term)
        before = past - term - (past[begin] - term[begin])[owner]
        whole = np.add.reduceat(term, begin)
        hole = (whole[owner] - term) % prime
        closed = (before + (whole[owner] - before - term) % prime * pow(base, -1, prime)) % prime
        found.append(np.concatenate([hole, closed[deleted], whole % prime]))
    k = np.concatenate([2 * sizes[owner], 2 * (sizes[owner][deleted] - 1) + 1, 2 * sizes + 1])
    role = np.concatenate([np.full(len(points), WILDCARD), np.full(int(deleted.sum()), DELETION), np.full(len(words), ITSELF)])
    rank = np.concatenate([ranks[owner], ranks[owner][deleted], ranks])
    return k, found[0] << 31 | found[1], found[2] << 31 | found[3], role.astype(np.int8), rank


def group_keys(ranked: DataFrame, shortest: int = MIN_LENGTH) -> DataFrame:
    """Rows (k, a, b, role, r) of a table (r, word) of non-empty words."""
    python_stage(ranked.sparkSession)
    names = ["k", "a", "b", "role", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
            sizes, start = np.cumsum([0] + [len(w) for w in words]), 0
            while start < len(words):
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE, side="right")) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in keys(words[start:end], ranks[start:end], shortest)], names=names)
                start = end

    return ranked.select("r", "word").mapInArrow(run, "k long, a long, b long, role byte, r long")


def near_words(keyed: DataFrame) -> DataFrame:
    """Per word with a near one: r, n_near, best (the least rank among its near words).

    The members of a group come together once, as ranks in order: a wildcard group has at most one member per
    letter of the alphabet, a word's insertions at most that many per place.
    """
    part = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("r")))
    groups = keyed.groupBy("k", "a", "b").agg(
        F.sort_array(part(WILDCARD)).alias("same"), F.sort_array(part(DELETION)).alias("longer"), F.max(F.when(F.col("role") == ITSELF, F.col("r"))).alias("itself"))
    said = lambda r, n, best: F.struct(r.alias("r"), n.cast("int").alias("n"), best.alias("best"))
    none = F.array().cast("array<struct<r: long, n: int, best: long>>")
    replaced = F.when(F.size("same") > 1, F.transform("same", lambda r: said(r, F.size("same") - 1, F.when(r == F.get("same", F.lit(0)), F.get("same", F.lit(1))).otherwise(F.get("same", F.lit(0))))))
    indels = F.when(F.col("itself").isNotNull() & (F.size("longer") > 0), F.concat(
        F.transform("longer", lambda r: said(r, F.lit(1), F.col("itself"))), F.array(said(F.col("itself"), F.size("longer"), F.get("longer", F.lit(0))))))
    met = groups.select(F.explode(F.concat(F.coalesce(replaced, none), F.coalesce(indels, none))).alias("m")).select("m.*")
    return met.groupBy("r").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(r, root) of a table (r, form): the last word behind each that has a form, by doubling the step; counts grow along it, so it ends."""
    at, step = space.save(forms.select("r", F.col("form").alias("root")), "roots-0"), 0
    while True:
        further = at.select(F.col("r").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        at = space.save(moved, f"roots-{step}")
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(words: DataFrame, shortest: int = MIN_LENGTH, times: int = FORM_TIMES) -> DataFrame:
    """Of a table (word, n) of distinct words: word, form, root, n, n_near, form_n."""
    space = Workspace(words.sparkSession, "spelling")
    # An order and a number in one: ranges of the sorted table are numbered one behind the other.
    ranked = space.save(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n"), "ranked")
    near = near_words(group_keys(ranked, shortest))
    leading = ranked.select(F.col("r").alias("best"), F.col("n").alias("best_n"))
    form: Column = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    linked = space.save(ranked.join(near.join(leading, "best"), "r", "left").select("r", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form")), "linked")
    last = roots(linked.filter("form is not null").select("r", "form"), space)
    name = lambda key, *more: ranked.select(F.col("r").alias(key), F.col("word").alias(f"{key}_word"), *more)
    named = last.join(name("root"), "root").select("r", "root_word")
    with_form = linked.filter("form is not null").join(name("form", F.col("n").alias("form_n")), "form").join(named, "r")
    return linked.filter("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n")).unionByName(
        with_form.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of
    largest n, of ties the first in code-point order, if that n is at least five times the word's; the root is
    the end of the chain of forms, the word itself if it has none. Null and empty texts have no words; a null
    id counts as an empty one; repeated rows count as often as they stand there. Runs of any length are
    handled alike. An empty table gives an empty result. Other columns are not read.
    """
    return variants(vocabulary(docs, text, id))
