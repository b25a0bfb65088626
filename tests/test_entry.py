"""The entry file without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    found = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True)
    count, *rest = found.stdout.split()
    assert int(count) > 100 and rest == ["False", "False", "True"], found.stderr
