"""The library without the text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(before: str) -> set[str]:
    code = f"import sys\n{before}\nimport __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_works_without_the_text_operators():
    from tidemark.workload import catalog

    for left_out in ("tidemark.llm", "corpus_pipeline"):
        assert _names(f"sys.modules[{left_out!r}] = None") == set(catalog.QUERIES)


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
