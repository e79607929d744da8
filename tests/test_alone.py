"""The library without its optional corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as entry
from tests.conftest import SF, make_session
names = entry.queries()
assert "ag02_by_party" in names and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert entry.entry(make_session()).count()
"""


def test_entry_without_the_corpus_operators(tmp_path):
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-3000:]
