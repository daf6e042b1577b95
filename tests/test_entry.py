import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_reference_query_has_sql():
    names = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert len(names) == 28 and names <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.resource for r in rows] == "R26 R9 R53 R76 R80 R0 R51 R29 R50 R68".split()


def test_nothing_outside_imports_the_corpus_package():
    for path in (ROOT / "accessloom").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                named = getattr(node, "module", None) or "" if isinstance(node, ast.ImportFrom) else " ".join(a.name for a in node.names) if isinstance(node, ast.Import) else ""
                assert "llm" not in named.split(".")
