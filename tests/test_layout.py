from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_training_data_operators():
    """The subpackage can be deleted: only the entry point looks for it."""
    for f in (ROOT / "weftgraph").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or "", *(a.name for a in n.names)] if isinstance(n, ast.ImportFrom) else []
            assert not any("llm" in x.split(".") for x in names), f


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_local_checkpoint():
    for f in (ROOT / "weftgraph").rglob("*.py"):
        assert "localCheckpoint(" not in f.read_text()
