import ast
import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 7
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert sql <= names and len(names) > 90


def test_names_without_the_training_data_operators(tmp_path):
    """The other queries are there without the subpackage, whether or not the pipeline's file is."""
    copytree(ROOT / "opslog", tmp_path / "opslog", ignore=ignore_patterns("llm", "__pycache__"))
    show = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(x.startswith('op') for x in e.queries()))"
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (tmp_path / name).write_text((ROOT / name).read_text())
        got = subprocess.run([sys.executable, "-B", "-c", show], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        n, n_sql, *others = got.stdout.split()
        assert got.returncode == 0 and int(n) > 90 and int(n_sql) > 80 and others == ["False", "False"], got.stderr


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "opslog").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            module = getattr(node, "module", None) or ""
            named = [a.name for a in getattr(node, "names", [])] if isinstance(node, ast.Import | ast.ImportFrom) else []
            assert "llm" not in module.split(".") and "llm" not in named, path
