from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, weight string, kept string, token string, _text string, root string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, clashing columns."""
    base, passage = prose(1, 120), prose(99, 30)
    texts = [None, "", "   \n", "one", "one two", "a b c d", "A b C d", base, base, base, base + " tail", base.replace("w1 ", "x1 ", 1), prose(2, 4000), prose(3, 80) + " " + passage + " " + prose(4, 60),
             passage + " " + prose(5, 90), prose(6, 50) + "\n" + passage, "spam eggs " * 40, "é ü ß naïve　co\x1cdé 漢字 " * 9, "#*$ %& |<> " * 12, "Licensed under the Apache License, Version 2.0.\n" + prose(7, 30)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", "s2", None][i % 4], None if t is None else len(t), "n", None, "w", "k", "t", "x", "r") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", "s0", 1, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "odd.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1], r[2], r[3]) for r in odd_rows()]
