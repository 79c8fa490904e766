"""The library stands without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


def test_nothing_in_the_library_imports_them():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"quern\.llm|corpus_pipeline", p.read_text()), p


def test_every_query_has_a_name_and_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 50


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_entry_imports_without_them(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *also))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and set(e.oracle_sql()) <= set(q) and not [x for x in q if x.startswith('op') or x == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "", "PYTHONPATH": str(tmp_path / "repo")}, check=True, timeout=120)


def test_what_they_need_is_not_taken_for_them():
    import __spark_entry__ as e

    assert e._absent(ModuleNotFoundError("x", name="quern.llm.common")) and e._absent(ModuleNotFoundError("x", name="corpus_pipeline"))
    assert not e._absent(ModuleNotFoundError("x", name="xxhash")) and not e._absent(ImportError("x"))
