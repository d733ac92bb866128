"""The rest of the repository without the folders of the training-data operators."""

import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_imports_without_llm(tmp_path):
    left = ("llm", ".git", "__pycache__", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*left))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    every, of_llm = map(int, done.stdout.split())
    assert every > 70 and of_llm == 0
