from __future__ import annotations

import json

from weftgraph.functions import scalar as S
from weftgraph.operators import semantic, source
from weftgraph.sources import artifacts, manifest


def tree(spark, rows):
    return spark.createDataFrame([(r, p, t.encode()) for r, p, t in rows], "repo string, path string, content binary")


def test_manifest(spark):
    made = tree(spark, [
        ("a", "weftgraph.yaml", "services:\n- name: api\n  path: src/api\nlibraries:\n- name: lib\n  path: pkg\nhosts:\n  lb.example: api\n  '*.x': lib\n"), ("b", "x.py", ""), ("c", "weftgraph.json", '{"services": [{"name": "d"}, {"name": "d"}]}'),
        ("g", "weftgraph.yml", "guidance: [rules]"), ("t", "tsconfig.json", ""), ("r", "Gemfile", ""), ("b", "README.md", "# T\n[![x](y)](z)\nA [tool](u). <b>Bold</b>.\n## Install\nno")])
    got = {(r.repo, r.kind, r.name) for r in manifest.read_specs(made).filter("error is null").collect()}
    assert got == {("a", "service", "api"), ("a", "library", "a/pkg"), ("b", "service", "b"), ("t", "service", "t"), ("r", "service", "r")}
    assert [(r.pos, r.pattern, r.target) for r in manifest.declared_hosts(made).orderBy("pos").collect()] == [(0, "lb.example", "api"), (1, "*.x", "lib")]
    assert {r.repo: r.language for r in manifest.primary_language(made).collect()}["t"] == "typescript"
    assert [r.opening for r in manifest.read_openings(made).collect()] == ["A tool. Bold."]


def test_artifacts(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"interfaces": [{"id": "x", "evidence": ["a:1"]}]}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"nodes": [{"id": "n", "line_start": 1}], "edges": [{"from": "n", "to": "m", "weight": 2}]}))
    (tmp_path / "r.jsonl").write_text('{"id": "q", "arm": "a", "parsed_answer": {"answer": ["s"]}}\n{"id": "q", "arm": "b", "error": "timeout"}\n')
    assert artifacts.read_interfaces(spark, str(tmp_path / "i.json")).first()["evidence"] == ["a:1"]
    nodes, edges = artifacts.read_call_graph(spark, str(tmp_path / "c.json"))
    assert nodes.count() == 1 and tuple(edges.first()) == ("n", "m", 2)
    assert {r.arm: r.answer for r in artifacts.read_runs(spark, str(tmp_path / "r.jsonl")).collect()} == {"a": ["s"], "b": None}


def test_source_is_given_or_refused(spark):
    texts = spark.createDataFrame([("f", 0, "old"), ("f", 1, "a\nb\nc")], "path string, rank int, text string")
    sha = spark.createDataFrame([("a\nb\nc",)], "t string").select(S.file_hash("t").alias("h")).first()["h"]
    symbols = spark.createDataFrame([("ok", "f", 2, 3, sha), ("bad", "f", 1, 1, "x"), ("gone", "g", 1, 1, "x"), ("any", "f", 1, 1, None)], "id string, path string, line_start int, line_end int, file_sha string")
    got = {r.id: (r.status, r.verified, r.span and r.span.text) for r in source.get_source(symbols, texts).collect()}
    assert got == {"ok": ("ok", True, "b\nc"), "bad": ("span_mismatch", True, None), "gone": ("unavailable", True, None), "any": ("ok", False, "old")}


def test_library_prompt(spark):
    rows = spark.createDataFrame([("l", "a/x.py", "One", 1), ("l", "a/x.py", "Two", 2), ("l", "a/b/y.py", "Three", 1), ("l", "a/b/y.py", "_p", 0)], "slug string, path string, name string, line int")
    assert semantic.library_grounding(rows).first()["prompt"] == "Three, One, _p, Two\na, b"  # one of each file a turn, private names last within their file
