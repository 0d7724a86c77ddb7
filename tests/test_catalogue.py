"""The catalogue's shape: every oracle has a query, and what stands in the entry file can be built without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_imports_without_the_optional_part():
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_f') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lectern").parts:
            assert "llm" not in p.read_text(), p
