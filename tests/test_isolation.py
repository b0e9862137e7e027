"""The library, its queries and its tools without the optional training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent


def test_the_rest_stands_alone(tmp_path):
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(HOME, tmp_path / "rest", ignore=away)
    code = "import __spark_entry__ as e, bench, tools.compare; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_part():
    files = [p for p in (HOME / "orderloom").rglob("*.py") if "llm" not in p.parts] + list((HOME / "checks").rglob("*.py"))
    assert files and not [p for p in files if "orderloom.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
