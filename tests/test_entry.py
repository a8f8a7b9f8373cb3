"""The core queries stand without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys, importlib.abc
class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names} or name in {names}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
import __spark_entry__ as job
print(len(job.queries()), sum(name.startswith("op") and name[2].isdigit() for name in job.queries()), len(job.oracle_sql()))
"""


@pytest.mark.parametrize("hidden", [["ahocorasick"], ["xxhash"], ["public_tokenizers"], ["corpus_pipeline"], ["passagelake.llm", "corpus_pipeline"]])
def test_core_queries_stand_alone(hidden):
    run = subprocess.run([sys.executable, "-c", HIDE.format(names=hidden, root=ROOT)], capture_output=True, text=True, cwd=ROOT)
    assert run.returncode == 0, run.stderr
    total, numbered, sql = map(int, run.stdout.split())
    assert numbered == 0 and total >= 100 and sql == total
    assert "left out" in run.stderr
