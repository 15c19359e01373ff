import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and "onset_s" in got.columns


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tracewell", tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'marker_pairs' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_broken_parts_are_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tracewell", tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, timeout=120, check=False)
    assert done.returncode and b"no_such_module_anywhere" in done.stderr


def test_corpus_parts_are_imported_nowhere_else():
    for path in (ROOT / "tracewell").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
