from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bin_packing, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality_rules, sharding, suffix_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


def test_sharding(docs, empty, rows):
    out = sharding.kd_shards(docs, 5).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.shard for r in out} <= set(range(5)) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    assert sharding.kd_shards(empty, 5).count() == 0


def test_sharding_is_even(spark):
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    sizes = [r.b for r in sharding.kd_shards(made, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.1 * sum(sizes) / 24


def truth_of_copies(rows, key):
    groups = Counter(key(t) for _, t, *_ in rows)
    best = {}
    for i, t, *_ in rows:
        k = key(t)
        if k not in best or (i is not None and (best[k] is None or i > best[k])):
            best[k] = i
    return groups, best


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(docs, empty, rows, digest):
    """Also with a digest of sixteen values: every collision must be resolved on the bytes."""
    out = exact_dedup.exact_dedup(docs, digest=digest).collect()
    groups, best = truth_of_copies(rows, lambda t: t or "")
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in out) == sorted((repr(i), repr(best[t or ""]), groups[t or ""]) for i, t, *_ in rows)
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs, digest=digest)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_license_expressions():
    assert license_scan.to_postfix("MIT OR (Apache-2.0 AND GPL-2.0 WITH x)") == ["MIT", "Apache-2.0", "GPL-2.0", "x", "with", "and", "or"]
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "( )"):
        assert license_scan.to_postfix(bad) is None
    assert license_scan.evaluate(license_scan.to_postfix("GPL-3.0-only OR MIT")) == ({"gpl", "mit"}, True)
    assert license_scan.evaluate(license_scan.to_postfix("GPL-3.0-only AND MIT")) == ({"gpl", "mit"}, False)


def test_long_license_expressions():
    """Nothing behind a tag is cut: an operand far back counts, and a parenthesis may close far back."""
    scan = lambda text: license_scan.scan(text, license_scan._automaton())
    tag = "// SPDX-License-Identifier: "
    *_, labels, score, expression, permissive = scan(tag + " AND ".join(["MIT"] * 40 + ["GPL-3.0-only"]) + " */ x")
    assert labels == {"mit", "gpl"} and score == 1.0 and permissive is False and expression.endswith(" AND GPL-3.0-only")
    *_, labels, score, expression, permissive = scan(tag + "(" + " OR ".join(["MIT"] * 50 + ["ISC"]) + ") AND (junk")
    assert labels == {"mit", "isc"} and score == 1.0 and permissive is True and expression.endswith(" ISC )")
    assert license_scan.tag_expression(": MIT*/ OR ISC\nOR BSD", 0) == "MIT" and license_scan.tag_expression(" :\nMIT", 0) == ""
    for text in ("MIT OR (", "MIT AND (ISC OR BSD) WITH", "(MIT OR (ISC)", ") MIT", "MIT MIT", "MIT --> OR ISC"):
        cut = re.split("-->", text)[0]
        tokens = re.findall(r"[()]|[^\s()]+", cut)
        best = next((" ".join(tokens[:n]) for n in range(len(tokens), 0, -1) if license_scan.to_postfix(" ".join(tokens[:n]))), "")
        assert license_scan.tag_expression(text, 0) == best


def test_license_scan(docs, empty, rows, spark):
    out = license_scan.scan_licenses(docs).collect()
    assert len(out) == len(rows)
    assert sorted(r.n_words for r in out) == sorted(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, *_ in rows)
    text = "x CC BY cc by\nMIT-license; gnu General public LICENSE\n// SPDX-License-Identifier: (LGPL-2.1 OR BSD-3-Clause) AND junk here"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 1, 7, "cc-by,gpl,mit")
    assert set(r.labels.split(",")) >= {"cc-by", "gpl", "mit", "lgpl", "bsd"} and r.score == 1.0
    assert license_scan.scan_licenses(empty).count() == 0


def rules_of(text):
    w = WORDS.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty, rows):
    out = by_rows(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert out == sorted(((i, *rules_of(t)) for i, t, *_ in rows), key=repr)
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.quality_rules(docs).filter("kept").count()


def test_hosts_are_shrunk(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    made = [(i, "bad", "rotten") for i in range(30)] + [(100 + i, good, "fine") for i in range(30)] + [(200, "bad", "tiny"), (201, good, "rotten"), (202, good, None)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert not out[201] and out[100] and out[202] and not out[0]


def test_language(docs, empty, spark, rows):
    words = {"en": "the of and with this that from have which".split(), "de": "der und nicht eine durch werden sich auch".split()}
    rng = np.random.default_rng(3)
    made = [(i, " ".join(rng.choice(words[k], 60)), k) for i in range(60) for k in (("en", "de")[i % 2],)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.language_table(table).collect()}
    assert all(out[i].lang_pred == k and 0 <= out[i].score <= 1 for i, _, k in made)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    odd = language_id.language_table(docs).collect()
    texts = dict((i, t) for i, t, *_ in rows)
    assert len(odd) == len(rows) and all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) for r in odd if r.doc_id is not None)
    assert language_id.language_table(empty).count() == 0


def test_learning_counts_copies_once(spark):
    """A group of copies that is nearly all of a language leaves its other texts to be learnt; so do short texts and texts of few letters."""
    other = spark.createDataFrame([(f"spam eggs {'abcdefghij'[i]} bacon ham toast beans sausage tea", "xx") for i in range(10)], "text string, lang string")
    copies = spark.range(200_000).select(F.lit("copy of a copy " * 25).alias("text"), F.lit("xx").alias("lang"))
    short = spark.createDataFrame([("kurz", "yy"), ("1 2 3", "yy"), ("", "zz"), (None, "zz"), ("12 34", "zz")], "text string, lang string")
    made = language_id.learn(other.unionByName(copies).unionByName(short))
    assert set(made) == {"xx", "yy"} and made["yy"] == b"kurz"
    assert all(f"eggs {c} bacon".encode() in made["xx"] for c in "abcdefghij") and made["xx"].count(b"copy of a copy") <= 25


def test_learning_draws_again(spark):
    """Texts that shrink to a word leave a dictionary short, so that more of them are drawn."""
    texts = spark.range(4000).select(F.concat(F.repeat(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" ")), 60)).alias("text"), F.lit("xx").alias("lang"))
    assert len(language_id.learn(texts, per_language=2_000)["xx"]) >= 1_900


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(20):
        data = bytes(rng.integers(97, 99, int(rng.integers(1, 300)), dtype=np.uint8)) if t % 2 else b"abcab" * int(rng.integers(1, 60)) + bytes(t)
        order = suffix_dedup.suffix_array(data)
        suffixes = [data[i:] for i in order]
        assert suffixes == sorted(data[i:] for i in range(len(data)))
        common = [0]
        for a, b in zip(suffixes, suffixes[1:], strict=False):
            k = 0
            while k < 50 and k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            common.append(k)
        assert suffix_dedup.common_prefixes(data, order, lanes=7).tolist() == common


def cut_of(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(i, first.get(w, i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            least = first.get(b[p : p + 50])
            if least is not None and (i is None or least < i):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_substring_dedup(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    out = by_rows(suffix_dedup.substring_table(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == sorted(cut_of(rows), key=repr)
    assert suffix_dedup.substring_table(empty).count() == 0


def suffix_chain(rows, per_shard, bits):
    """The stages of the substring deduplication on lists, without Spark: removed flags per row."""
    import pyarrow as pa

    s = suffix_dedup
    texts = [(s.NO_ID if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    shards = [texts[k : k + per_shard] for k in range(0, len(texts), per_shard)]
    packed = [pa.RecordBatch.from_pydict({"shard": [str(k)], "ids": [s.squeeze(np.array([i for i, _ in part]).tobytes())], "ends": [s.squeeze(np.cumsum([len(b) for _, b in part]).tobytes())], "data": [s.squeeze(b"".join(b for _, b in part))]}) for k, part in enumerate(shards)]

    keys = np.arange(1 << bits)

    class Frame:  # what mapInArrow and applyInArrow need
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, _):
            return [x for b in self.batches for x in run(iter([b]))]

    def by(batches, column, run=None):
        table = pa.Table.from_batches(batches)
        found = {k: table.filter(pa.compute.equal(table.column(column), k)) for k in sorted(set(table.column(column).to_pylist()))}
        return found if run is None else [b for t in found.values() for b in run(t).to_batches()]

    def lists(batches):
        return {k: sorted(t.column("blob").to_pylist()) for k, t in by(batches, "shard").items()} if batches else {}

    shared = lists(by(s._minimizers(Frame(packed), bits, keys), "bucket", s._shared))
    joined = [b.append_column("shared", pa.array([shared[k]], pa.list_(pa.binary()))) for b in packed if (k := b.column(0)[0].as_py()) in shared]
    answers = lists(by(s._forms(Frame(joined), bits, keys), "bucket", s._decided))
    last = [b.append_column("shared", pa.array([shared.get(k, [])], pa.list_(pa.binary()))).append_column("decided", pa.array([answers.get(k, [])], pa.list_(pa.binary()))) for b in packed for k in [b.column(0)[0].as_py()]]
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for b in s._cut(Frame(last), False) for r in b.to_pylist()]


def test_content_shards_are_dealt_one_to_a_task(spark):
    for n in (1, 2, 64):
        keys = suffix_dedup.even_keys(spark, n)
        made = spark.createDataFrame([(int(k),) for k in keys], "bucket long").repartition(n, "bucket").select(F.spark_partition_id().alias("p"))
        assert len({r.p for r in made.collect()}) == n == len(set(keys.tolist()))


@pytest.mark.parametrize("change", [{}, {"ARRAY_BYTES": 300}, {"HOT_RUNS": 2}, {"HOT_RUNS": 2, "ARRAY_BYTES": 200}, {"CHUNK": 97}, {"RUN": 3, "ARRAY_BYTES": 500}, {"HASH_BITS": 3, "ARRAY_BYTES": 250}])
def test_substring_stages(rows, monkeypatch, change):
    """All branches: pieces of a minimizer merged by binary search, hot minimizers taken apart, texts looked at in chunks, colliding hashes."""
    for name, value in change.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    if "CHUNK" in change:
        monkeypatch.setattr(suffix_dedup.Runs.__init__, "__defaults__", (None, None, change["CHUNK"]))
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc"), 80)) for _ in range(6)]
    crossing = [(50 + k, "".join(texts[x] for x in rng.integers(0, 6, 4)), None, None) for k in range(40)]  # every passage in many contexts
    odd = [(200, " " * 900, None, None), (201, "ab" * 300 + " " * 400, None, None), (202, "\0" * 120, None, None), (203, "x" + "\0" * 110, None, None), (204, None, None, None), (50, crossing[3][1], None, None)]
    for table, per_shard, bits in (([*rows, *crossing, *odd], 7, 1), (crossing, 100, 0), (odd, 1, 2)):
        assert sorted(suffix_chain(table, per_shard, bits), key=repr) == sorted(cut_of(table), key=repr)


def first_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= x), None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return len(rooms)


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    path = bin_packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    out = bin_packing.pack(docs, path, 256).collect()
    assert sorted((repr(r.doc_id), *r[1:5]) for r in out) == sorted((repr(w[0]), *w[1:]) for w in want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= first_fit([w[3] for w in want], 256)
    assert bin_packing.pack(empty, path, 256).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(20):
        histogram = Counter(rng.integers(1, 65, 200).tolist())
        plan = bin_packing.plan(dict(histogram), 64)
        used = Counter()
        for pattern, times in plan:
            assert sum(x * n for x, n in pattern.items()) <= 64
            for x, n in pattern.items():
                used[x] += n * times
        assert used == histogram and sum(t for _, t in plan) <= 1.02 * first_fit(histogram.elements(), 64)  # neither heuristic dominates on so few pieces


def test_encoder_matches_tokenizer():
    e = bin_packing.WordEncoder(bin_packing.default_tokenizer(), 500)
    for x in ("It's DON'T we'll 3.5% a'b 's ''s", "Ünïcode ÉCOLE ß İ ΣΑΣ x　y", "a\x1cb <|endoftext|> c", "naïve1२3 ½", "", "  ", "<|ENDOFTEXT|> x", "á ́b", "́ x", "w" * 70_000 + " x " * 9):
        assert e.encode(x) == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1])[0] == 30 and sum(mixing.targets([10, 100, 100], [5, 2, 1])) == pytest.approx(210)
    split = mixing.split_quotas([100, 7, 0, 33], 8)
    assert split.sum(axis=0).tolist() == [100, 7, 0, 33] and np.ptp(split.sum(axis=1)) <= 1
    assert (mixing.split_quotas([100, 7, 0, 33], 8) == split).all()


def test_mixing(docs, empty, rows):
    out = mixing.mix_table(docs).collect()
    assert sorted(r.size for r in out) == sorted(len(WORDS.findall(t or "")) for _, t, *_ in rows)
    assert all(r.taken <= 3 * r.size for r in out) and sum(r.target for r in {x.target: x for x in out}.values()) == pytest.approx(sum(r.size for r in out))
    assert by_rows(mixing.mix_table(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in out), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.draws) for r in out)
    assert mixing.mix_table(empty).count() == 0


def test_mixing_reaches_targets(spark):
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("source"))
    out = mixing.mix_table(made).groupBy("target").agg(F.sum("taken").alias("t"), F.max(F.size("draws")).alias("k")).collect()
    assert all(abs(r.t - r.target) <= 37 and r.k <= 3 for r in out)


def test_mixed_rows_stand_by_shard(spark):
    """The written mix follows the draws: a shard stands in one partition, in the order of places."""
    made = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    where = {}
    for r in mixing.mix_table(made, shards=5).collect():
        for d in r.draws:
            where.setdefault(r.doc_id, []).append((d.shard, d.place, d.epoch))
    parts = {}
    for r in mixing.mixed_documents(made, shards=5).withColumn("p", F.spark_partition_id()).collect():
        parts.setdefault(r.p, []).append(r.doc_id)
    wanted = sorted((*at, i) for i, draws in where.items() for at in draws)
    assert sum(map(len, parts.values())) == len(wanted) and len({s for s, *_ in wanted}) > 1
    shard = {s: [i for t, *_, i in wanted if t == s] for s, *_ in wanted}
    for ids in parts.values():
        assert any(ids == sum(map(shard.get, some), []) for n in range(1, 6) for some in combinations(sorted(shard), n))


def test_toxicity(docs, empty, spark, rows):
    rng = np.random.default_rng(4)
    made, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if toxic:
            for k in rng.integers(0, 40, 3):
                w[k] = rng.choice(["vile", "nasty", "awful"])
        made.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    t = spark.createDataFrame(made, "doc_id long, text string")
    held = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_table(t, held).collect()}
    tested = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out for i in tested) and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted == labels[i][1] for i in tested) > 0.9 * len(tested)
    assert toxicity.toxicity_table(docs, held).count() == len(rows) and toxicity.toxicity_table(empty, held).count() == 0
    assert toxicity.toxicity_table(docs, held.limit(0)).agg(F.max("predicted")).first()[0] == 0


def groups_of(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORDS.findall(w)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(rows[k][0], len(sets[k]), least.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows))]


@pytest.mark.parametrize("long", [2, 16])
def test_jaccard(docs, empty, rows, spark, monkeypatch, long):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    assert by_rows(jaccard_join.jaccard_components(docs, 4, 85), "doc_id", "n_shingles", "component_id") == sorted(groups_of(rows, 4, 85), key=repr)
    if long == 16:
        assert jaccard_join.jaccard_components(empty).count() == 0
        return
    import random

    r = random.Random(8)
    base, made = [f"b{r.randrange(60)}" for _ in range(70)], []
    for i in range(60):  # near copies at all distances, a passage that all share
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"e{r.randrange(999)}"
        made.append((i, " ".join(w) if i % 3 else " ".join(f"u{r.randrange(99)}" for _ in range(40)) + " " + " ".join(base[:8]), None, None))
    table = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    assert by_rows(jaccard_join.jaccard_components(table, 4, 85), "doc_id", "n_shingles", "component_id") == sorted(groups_of(made, 4, 85), key=repr)
    kept = jaccard_join.keep_one_of_each(table, 4, 85)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({g[2] for g in groups_of(made, 4, 85)})


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: [None, 7, i][i % 3]], ids=["null", "one", "mixed"])
def test_jaccard_of_rows_without_ids_of_their_own(spark, monkeypatch, ids):
    """Every text is made a set once, whatever ids its rows have."""
    words = lambda k: " ".join(f"{k}-{i}" for i in range(40))
    table = [(ids(i), None if i == 50 else "" if i == 51 else words(i // 3) + " x" * (i % 3), None, None) for i in range(120)]
    sets, seen = jaccard_join._sets, []
    monkeypatch.setattr(jaccard_join, "_sets", lambda docs, size: seen.append(docs.count()) or sets(docs, size))
    docs = spark.createDataFrame([t[:2] for t in table], "doc_id long, text string")
    assert by_rows(jaccard_join.jaccard_components(docs, 4, 85), "doc_id", "n_shingles", "component_id") == sorted(groups_of(table, 4, 85), key=repr)
    assert sum(seen) <= len(table)


def test_one_of_each_with_repeated_and_null_ids(spark):
    """Rows and not ids are dropped: exactly one of each component stays, and every clean row."""
    words = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    table = [(1, words("a")), (2, words("a") + " x"), (2, words("clean")), (3, words("b")), (3, words("b") + " x"), (None, words("c")), (None, words("c") + " x"), (None, words("d")), (7, words("d") + " x"), (None, None), (9, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = Counter((r.doc_id, (r.text or "").split(" ")[0]) for r in jaccard_join.keep_one_of_each(docs).collect())
    assert kept == Counter([(1, "a0"), (2, "clean0"), (3, "b0"), (None, "c0"), (7, "d0"), (None, ""), (9, "")])
    assert jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0
