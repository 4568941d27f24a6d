"""The driver's contract, and that nothing but the entry knows the llm subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "lakeglass").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert not re.search(r"lakeglass\.llm|from \.+llm|import llm|corpus_pipeline", p.read_text(encoding="utf-8")), p


def test_the_rest_works_without_it(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op') or k == 'pipeline'] and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert int(out.stdout) > 100
