"""What must hold of the repository itself."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_training_data_subpackage():
    for path in [*ROOT.glob("tidewell/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tidewell.llm", "corpus_pipeline")) for n in names), path


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
