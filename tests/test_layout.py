import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_subpackage():
    for path in [*(ROOT / "tidemark").rglob("*.py"), ROOT / "bench.py", *(ROOT / "tests").glob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tidemark.llm", "corpus_pipeline")) for n in names), path


def test_entry_has_the_engine_whatever_else_is_there(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"clip_incidents", "window_signals", "tumbling"} <= names
    assert set(entry.oracle_sql()) <= names
    assert entry.entry(spark).count() == 15
