"""The driver's contract, with and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "textloom").parts:
            assert "textloom.llm" not in path.read_text(), path


def test_works_without_it():
    code = "import sys; sys.modules['textloom.llm'] = None\nimport __spark_entry__ as e; assert 'o_kw_4' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
