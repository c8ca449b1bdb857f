import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
from tidemark.operators import CATALOG

ROOT = Path(__file__).resolve().parents[1]


def test_every_operator_has_a_query_and_sql():
    assert len(CATALOG) == 62
    assert set(CATALOG) <= set(e.queries()) and set(CATALOG) <= set(e.oracle_sql())


def test_imports_without_the_text_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == 2 * 62 + 4 and len(e.oracle_sql()) == 2 * 62 + 2"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_imports_where_the_text_subpackage_cannot():
    """What it needs may be missing: the indicators' queries stay, with a warning."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) >= 62 and 'op6_suffix_dedup' not in e.queries()"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True)
    if (ROOT / "tidemark" / "llm").exists():
        assert "no text queries" in got.stderr


def test_nothing_else_imports_it():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tidemark.llm" not in p.read_text(), p


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns[:2] == ["symbol", "ts"] and df.count() > 1000
