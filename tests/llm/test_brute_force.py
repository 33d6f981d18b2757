"""Results of the registered operators against plain re-computations, and rows with odd names and very long texts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import WORDS, groups_of, rules_of
from weftgraph.llm import bin_packing, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality_rules, sharding, toxicity, work


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """(doc_id, text, lang, source) with copies, a hot source and groups of copies under other metadata."""
    r = random.Random(11)
    rows = []
    for i in range(600):
        text = " ".join(r.choice(("alpha", "beta", "mit", "license", "gnu", "general", "public", "cc", "by", "apache", "x")) + r.choice(("", "", ",", "-")) for _ in range(r.randrange(1, 60)))
        rows.append((i, text, r.choice(("en", "de", None)), "hot" if i % 3 else f"s{i % 11}"))
    for i in range(600, 900):
        rows.append((i, rows[i % 40][1], r.choice(("en", "fr")), f"t{i % 5}"))
    return rows


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3)


def test_shards_are_boxes_of_even_size(table, corpus):
    out = {r.doc_id: r for r in sharding.kd_shards(table, 8).collect()}
    size = {i: len(t.encode()) + 8 for i, t, *_ in corpus}
    weight = Counter()
    for i, r in out.items():
        assert r.size == size[i] and r.text_crc32 == zlib.crc32(corpus[i][1].encode())
        weight[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(weight) == 8 and all(abs(w - mean) <= 2 * sharding.WHOLE_GROUP * mean + max(size.values()) for w in weight.values())
    homes = {}
    for i, t, *_ in corpus:
        homes.setdefault(t, []).append(i)
    for ids in homes.values():  # equal texts, whatever their metadata
        if sum(size[i] for i in ids) <= sharding.WHOLE_GROUP * mean:
            assert len({out[i].shard for i in ids}) == 1


def test_a_large_group_of_copies_is_split(spark):
    made = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    sizes = Counter()
    for r in sharding.kd_shards(made, 6).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 6 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_target_bytes(table, corpus):
    total = sum(len(t.encode()) + 8 for _, t, *_ in corpus)
    for target in (total, total // 3, 2000):
        assert len({r.shard for r in sharding.kd_shards(table, target_bytes=target).collect()}) == -(-total // target)
    for wrong in ({}, {"shards": 3, "target_bytes": 5}):
        with pytest.raises(ValueError):
            sharding.kd_shards(table, **wrong)


def test_licenses_by_hand(table, corpus):
    phrases = {tuple(k.split()): v for k, v in license_scan.BASE_PHRASES.items()}
    found = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    hits = 0
    for i, t, *_ in corpus:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        hits += len(at)
    assert hits > 50


def test_a_long_licence_text_takes_time_in_proportion():
    import time

    automaton = license_scan._automaton()
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert license_scan.scan("mit license " * n, automaton)[1][-1] == 2 * n - 2
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_language_by_hand(spark):
    import zstandard

    r, alphabets = random.Random(5), {"aa": "abcde", "bb": "abfgh", "cc": "xyzab"}
    words = {k: ["".join(r.choice(a) for _ in range(r.randrange(3, 8))) for _ in range(80)] for k, a in alphabets.items()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randrange(9, 400))), k) for i in range(150) for k in [list(alphabets)[i % 3]]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 34!", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter(language_id.fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    assert set(model) == set(alphabets)
    found = {x.doc_id: x for x in language_id.language_table(docs).collect()}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert found[i].lang_pred == "und"
            continue
        body, sizes = language_id.plain(t), {}
        for k, d in sorted(model.items()):
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=language_id.LEVEL)
            c = zstandard.ZstdCompressor(dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(body[a : a + language_id.PIECE_BYTES])) for a in range(0, len(body), language_id.PIECE_BYTES))
        best = min(sizes, key=lambda k: (sizes[k], k))
        first, second = sorted(sizes.values())[:2]
        assert found[i].lang_pred == best and found[i].score == pytest.approx(1 - first / second)
    held = [x for x in rows[:150] if found[x[0]].held_out]
    assert sum(found[i].lang_pred == k for i, _, k in held) >= 0.95 * len(held)


def test_mixing_by_hand(table, corpus):
    out = {r.doc_id: r for r in mixing.mix_table(table, shards=4).collect()}
    size = {i: len(WORDS.findall(t)) for i, t, *_ in corpus}
    names = sorted({s for *_, s in corpus})
    source_size = {s: sum(size[i] for i, _, _, x in corpus if x == s) for s in names}
    goal, left = {}, dict(zip(names, (5, 2, 1) * len(names), strict=False))
    while True:  # water is poured by weight until no source is over three times its size
        rest, weight = sum(source_size.values()) - sum(goal.values()), sum(left.values())
        over = [s for s, w in left.items() if rest * w / weight > 3 * source_size[s]]
        if not over:
            goal |= {s: rest * w / weight for s, w in left.items()}
            break
        for s in over:
            goal[s] = 3 * source_size[s]
            del left[s]
    taken = Counter()
    for i, _, _, s in corpus:
        r = out[i]
        assert (r.size, r.source_size) == (size[i], source_size[s]) and r.target == pytest.approx(goal[s]) and r.taken == len(r.draws) * size[i] <= 3 * size[i]
        assert len({d.epoch for d in r.draws}) == len(r.draws) and all(0 <= d.shard < 4 for d in r.draws)
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(size.values()) for s in names)
    # within a source, shards are disjoint stretches of its permuted blocks
    for s in names:
        for e in range(3):
            assert sum(1 for i, *_, x in corpus if x == s for d in out[i].draws if d.epoch == e) in (0, *range(1, len(corpus)))


def test_mixing_without_broadcast(table, monkeypatch):
    want = sorted((r.doc_id, r.taken) for r in mixing.mix_table(table).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_table(table).collect()) == want


def test_other_paths_than_broadcast(table, corpus, monkeypatch):
    rows = [(i, t, k, s) for i, t, k, s in corpus]
    judged = sorted((r.doc_id, r.kept) for r in quality_rules.quality_rules(table).collect())
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST", -1)
    assert sorted((r.doc_id, r.kept) for r in quality_rules.quality_rules(table).collect()) == judged
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST", -1)
    found = jaccard_join.jaccard_components(table, 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(groups_of(rows, 4, 85))


def test_rank_over_several_bins(spark, monkeypatch):
    made = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    ranked = work.with_rank(made, "g", [F.col("id")], [F.col("id")], 10 * work.BIN_ROWS, "r")
    seen = {}
    for r in ranked.collect():
        seen.setdefault(r.g, []).append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and sum(map(len, seen.values())) == 500


def test_hypergeometric_beyond_the_sampler():
    rng = np.random.default_rng(1)
    have = np.array([4 * 10**9, 10**9, 0, 5])
    out = mixing._hypergeometric(rng, have, 2_500_000_000)
    assert out.sum() == 2_500_000_000 and (out <= have).all() and abs(out[0] - 2 * 10**9) < 10**6


def test_ftrl_by_hand():
    """The vectorized learner against the update written out coordinate by coordinate."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 16, 5)), int(rng.random() < 0.5)) for _ in range(60)]
    model, z, n = toxicity.Ftrl(4), [0.0] * 17, [0.0] * 17
    for features, y in rows:
        model.learn(features, y)
        at = [*features.tolist(), 16]
        w = {i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


def test_toxicity_features_by_hand(spark):
    """Scores are the bias plus the weights of the distinct words, pairs and skip pairs."""
    made = toxicity.Features()
    h = made.words("Bad, bad dog barks")
    pairs = lambda x, y, skip: ((int(x) * (0xC2B2AE3D27D4EB4F if skip else 0x9E3779B97F4A7C15) + int(y) + skip) * 0xD6E8FEB86659FD93) % 2**64
    want = {int(x) * 0xD6E8FEB86659FD93 % 2**64 for x in h} | {pairs(a, b, 0) for a, b in zip(h, h[1:], strict=False)} | {pairs(a, b, 1) for a, b in zip(h, h[2:], strict=False)}
    assert set(made.of(h).tolist()) == {x >> (64 - toxicity.BITS) for x in want}
    at = made.of(h)
    docs = spark.createDataFrame([(1, "Bad, bad dog barks"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, (np.append(at, 1 << toxicity.BITS), np.append(np.full(len(at), 0.25), -1.0).astype(np.float32))).collect()}
    assert got[1] == pytest.approx(1 / (1 + np.exp(1 - 0.25 * len(at)))) and got[2] == pytest.approx(1 / (1 + np.e))


def test_pipeline_stages_by_hand(spark, tmp_path):
    """Each stage on what the one before kept, against its brute-force version."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows = [(i, say(r.randrange(20, 90)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)]
    rows += [(200 + i, rows[20 + i][1] + " end", "en", "s2", 1) for i in range(5)]
    rows += [(300, "too short", "en", "s0", 1), (301, None, "en", None, None), (302, "spam eggs " * 30, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "ngram_jaccard", "source_mixing", "best_fit_packing"]

    def step(name, at):
        stages[name](spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    ids = lambda df: sorted(x.doc_id for x in df.collect())
    good = step("quality_rules", spark.read.parquet(str(tmp_path / "documents.parquet")))
    passed = [x for x in rows if rules_of(x[1])[0] >= 10 and 100 * rules_of(x[1])[4] <= 20 * rules_of(x[1])[0]]
    assert ids(good) == sorted(x[0] for x in passed)
    once = step("exact_dedup", good)
    best = {t: max(i for i, u, *_ in passed if u == t) for _, t, *_ in passed}
    assert ids(once) == sorted(best.values())
    apart = step("ngram_jaccard", once)
    kept = [x for x in passed if x[0] in best.values()]
    assert ids(apart) == sorted({c for _, _, c in groups_of(kept, 5, 80)})
    mixed = step("source_mixing", apart)
    draws = {x.doc_id: len(x.draws) for x in mixing.mix_table(apart).collect()}
    assert ids(mixed) == sorted(i for i, n in draws.items() for _ in range(n))
    packed = step("best_fit_packing", mixed).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bin_packing.default_tokenizer())
    text = {x[0]: x[1] for x in rows}
    want = Counter((i, len(t.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in draws.items() for _ in range(n))
    assert Counter((x.doc_id, x.length) for x in packed) == want
    bins = Counter()
    for x in packed:
        bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


CLASH = ["_metadata", "__weft_locator", "__weft_row", "_mix_size", "_mix_draws", "_mix_source", "_doc", "_text", "_host", "_row", "_id", "_null", "_bad", "component_id", "root", "base_failed"]


def test_columns_of_any_name_stay(spark):
    rows = [(i if i % 5 else None, f"some words number {i % 9} " * 3 + "and ten more of them so that rules are met", "en", "s", 1, *range(len(CLASH))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH))
    for make in (quality_rules.keep_quality, exact_dedup.drop_exact_duplicates, jaccard_join.keep_one_of_each, mixing.mixed_documents):
        out = make(docs)
        assert out.columns == docs.columns and {tuple(r[c] for c in CLASH) for r in out.collect()} <= {tuple(range(len(CLASH)))}
    assert exact_dedup.exact_dedup(docs).count() == 30 and mixing.mix_table(docs).count() == 30


def test_very_long_texts(spark):
    """A text of more than a megabyte goes through every operator whole."""
    from weftgraph.llm import suffix_dedup

    r = random.Random(8)
    long = " ".join(f"v{r.randrange(50_000)}" for _ in range(200_000))
    half = long[: len(long) // 2]
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, half, "en", "b"), (3, half + " tail", "en", "b"), (4, long, "de", "a")], "doc_id long, text string, lang string, source string")
    n = len(long.split(" "))
    assert {x.doc_id: x.size for x in sharding.kd_shards(docs, 2).collect()}[1] == len(long) + 8
    assert {x.doc_id: x.keep_id for x in exact_dedup.exact_dedup(docs).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}
    assert {x.doc_id: x.n_words for x in license_scan.scan_licenses(docs).collect()}[4] == n
    assert {x.doc_id: x.n_words for x in quality_rules.quality_rules(docs).collect()}[1] == n
    assert {x.doc_id for x in language_id.language_table(docs).collect()} == {1, 2, 3, 4}
    assert {x.doc_id: x.n_removed for x in suffix_dedup.substring_table(docs).collect()} == {1: 0, 2: len(half), 3: len(half), 4: len(long)}
    ids = sum(x.length for x in bin_packing.pieces(docs.filter("doc_id = 1"), bin_packing.default_tokenizer()).collect())
    assert ids > n
    assert {x.doc_id: x.size for x in mixing.mix_table(docs).collect()}[1] == n
    assert toxicity.toxicity_table(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 4
    assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_table(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
