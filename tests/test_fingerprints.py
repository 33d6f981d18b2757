"""Kept facts: reused as long as content and readers are the same, read again below what changed, refused otherwise."""

from __future__ import annotations

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_index import APP, made

from weftgraph import fingerprints, index
from weftgraph.catalog import Catalog
from weftgraph.fingerprints import FactStore, StaleFacts
from weftgraph.sources import registry

REPOS = {
    "py": {"app.py": APP, "lib/a.py": "def a(): ...\n", "lib/deep/b.py": "def b(): ...\n", "other/c.py": "def c(): ...\n"},
    "js": {"server.js": "import express from 'express'\nconst app = express()\napp.get('/x/:id', handler)\n", "routes.js": "module.exports = (app) => { app.post('/y', h) }\n"},
}


def facts_of(rows):
    return sorted(map(repr, (tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect())))


def states(spark, repos):
    leaves = fingerprints.leaves(made(spark, repos))
    return leaves, fingerprints.nodes(leaves)


def read_by(log):
    """A reader of single files that writes down what it reads."""
    log = str(log)

    def each(files):
        @F.udf("string")
        def seen(path):
            with open(log, "a") as f:
                f.write(path + "\n")
            return path

        return files.select("repo", F.col("path").alias("file"), F.lit("seen").alias("fact"), seen("path").alias("name"))

    return each


def test_a_tree_says_what_its_files_say(spark):
    held = {(r.repo, r.node): r for r in states(spark, REPOS)[1].collect()}
    assert sorted(n for r, n in held if r == "py") == ["", "lib", "lib/deep", "other"] and held["py", ""].files == 4 and held["py", "lib"].bytes == len("def a(): ...\n" * 2)
    moved = {"py": {k.replace("lib/", "src/"): v for k, v in REPOS["py"].items()}}
    again = {(r.repo, r.node): r.hash for r in states(spark, moved)[1].collect()}
    assert again["py", "src"] == held["py", "lib"].hash and again["py", ""] != held["py", ""].hash and again["py", "other"] == held["py", "other"].hash
    # contents that change places, a file and a folder of one content
    swapped = {"py": REPOS["py"] | {"lib/a.py": REPOS["py"]["other/c.py"], "other/c.py": REPOS["py"]["lib/a.py"]}}
    assert {n for (r, n) in held if r == "py" and {(x.repo, x.node): x.hash for x in states(spark, swapped)[1].collect()}[r, n] != held[r, n].hash} == {"", "lib", "other"}


def test_changes_are_those_of_comparing_all(spark):
    r = random.Random(3)
    paths = [f"{a}{b}{c}.py" for a in ("", "x/", "y/") for b in ("", "d/", "e/f/") for c in "klm"]
    old = {repo: {p: f"v{r.randrange(3)}" for p in r.sample(paths, 18)} for repo in ("one", "two", "same", "gone")}
    new = {repo: {p: f"v{r.randrange(3)}" for p in r.sample(paths, 18)} for repo in ("one", "two")} | {"same": old["same"], "new": {"a.py": "v"}}
    told = fingerprints.changes(states(spark, old), states(spark, new))
    flat = lambda s: {(repo, p): v for repo, files in s.items() for p, v in files.items()}
    a, b = flat(old), flat(new)
    assert {(x.repo, x.path, x.change) for x in told.collect()} == {(*k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def test_only_what_changed_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "MOST_SEGMENTS", 3)
    whole = lambda files: files.groupBy("repo").agg(F.count(F.lit(1)).cast("string").alias("name")).select("repo", F.lit("count").alias("fact"), "name")
    adapters = (*registry.ADAPTERS, registry.Adapter("counting", whole))
    store, repos = FactStore(spark, str(tmp_path / "facts"), adapters), {k: dict(v) for k, v in REPOS.items()}
    with pytest.raises(StaleFacts, match="no facts"):
        store.load(made(spark, repos))
    steps = [
        (lambda: None, (6, 0, 0)), (lambda: None, (0, 0, 0)), (lambda: repos["py"].update({"lib/a.py": "def z(): ...\n"}), (0, 1, 0)),
        # the repository names Express no more, so that the other file's application is no route
        (lambda: repos["js"].update({"server.js": "let x = 1\n"}), (0, 1, 0)),
        (lambda: (repos["py"].pop("other/c.py"), repos["js"].update({"new.ts": "export function n() { }\n"})), (1, 0, 1)),
    ]
    for step, counts in steps:
        step()
        files = made(spark, repos)
        if any(counts):
            with pytest.raises(StaleFacts):
                store.load(files)
            assert store.status(files).count() == sum(counts)
        facts, report = store.refresh(files)
        assert (report["added"], report["changed"], report["removed"]) == counts and report["read"] == counts[0] + counts[1]
        wanted = facts_of(registry.discover(files, adapters))
        assert facts_of(facts) == wanted and facts_of(store.load(files)) == wanted
    assert len(store._entry()["facts"]) < 3  # segments were written as one
    # a part of the repositories leaves the others as they are kept
    part = made(spark, {"js": repos["js"] | {"more.js": "let y = 2\n"}})
    assert store.refresh(part)[1]["added"] == 1 and facts_of(store.load(made(spark, {"py": repos["py"]}))) == facts_of(registry.discover(made(spark, {"py": repos["py"]}), adapters))
    assert store.sweep(keep_hours=0) and facts_of(store.load(part)) == facts_of(registry.discover(part, adapters))
    store.forget(spark.createDataFrame([("js",)], "repo string"))
    with pytest.raises(StaleFacts, match="the first is js"):
        store.load(part)
    # other readers: nothing that is kept is used
    newer = FactStore(spark, store.root, (*registry.ADAPTERS, replace(adapters[-1], version="2")))
    with pytest.raises(StaleFacts, match="other readers"):
        newer.load(part)
    assert newer.refresh(part)[1]["read"] == 4


def test_files_that_did_not_change_are_not_opened(spark, tmp_path):
    for repo, files in REPOS.items():
        for path, text in files.items():
            at = tmp_path / "src" / repo / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
            os.utime(at, (1_700_000_000, 1_700_000_000))
    repos = spark.createDataFrame([(r, str(tmp_path / "src" / r)) for r in REPOS], "repo string, root string")
    store = FactStore(spark, str(tmp_path / "facts"))
    every = lambda: facts_of(registry.discover(made(spark, {r: {str(p.relative_to(tmp_path / "src" / r)): p.read_text() for p in (tmp_path / "src" / r).rglob("*") if p.is_file()} for r in REPOS})))
    assert store.refresh_folders(repos)[1] == {"files": 6, "added": 6, "changed": 0, "removed": 0, "read": 6, "opened": 6}
    assert store.refresh_folders(repos)[1] == {"files": 6, "added": 0, "changed": 0, "removed": 0, "read": 0, "opened": 0}
    os.utime(tmp_path / "src/py/app.py", (1_700_000_009, 1_700_000_009))  # touched: opened, not parsed
    facts, report = store.refresh_folders(repos)
    assert (report["opened"], report["read"]) == (1, 0) and facts_of(facts) == every()
    assert store.refresh_folders(repos)[1]["opened"] == 0
    (tmp_path / "src/py/lib/a.py").write_text("def q(): ...\n")  # of the old length, just now
    facts, report = store.refresh_folders(repos)
    assert (report["opened"], report["read"], report["changed"]) == (1, 1, 1) and facts_of(facts) == every()
    at = os.stat(tmp_path / "src/py/lib/a.py").st_mtime_ns
    (tmp_path / "src/py/lib/a.py").write_text("def r(): ...\n")  # of the same length, at the same time
    os.utime(tmp_path / "src/py/lib/a.py", ns=(at, at))
    facts, report = store.refresh_folders(repos)
    assert report["changed"] == 1 and facts_of(facts) == every()


def test_indexing_with_kept_facts(spark, tmp_path):
    plain, kept = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    log = tmp_path / "log"
    store = FactStore(spark, str(tmp_path / "facts"), (*registry.ADAPTERS, registry.Adapter("seen", read_by(log), each=read_by(log))))
    repos = {k: dict(v) for k, v in REPOS.items()}
    for change in ({}, {"lib/a.py": "def changed(): ...\n"}):
        repos["py"].update(change)
        log.write_text("")
        files = made(spark, repos)
        index.index(plain, files)
        index.index(kept, files, kept=store)
        assert sorted(log.read_text().split()) == sorted(change or [p for files in REPOS.values() for p in files])  # each once
        for table in ("objects", "edges"):
            a, b = (c.table(table).drop("last_generated_at") for c in (plain, kept))
            assert facts_of(a) == facts_of(b)
