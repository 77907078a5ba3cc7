"""The entry module without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
COUNT = """
import importlib.abc, sys
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:{depth}] == {name}.split("."):
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len(entry.queries()), any(q.startswith("op") for q in entry.queries()), "pipeline" in entry.queries())
"""


@pytest.mark.parametrize("blocked", ["ahocorasick", "surfex.llm", "corpus_pipeline"])
def test_entry_without(blocked):
    code = COUNT.format(name=repr(blocked), depth=blocked.count(".") + 1)
    count, numbered, pipeline = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True).stdout.split()[-3:]
    assert int(count) >= 177
    assert numbered == str(blocked == "corpus_pipeline")
    assert pipeline == str(blocked == "ahocorasick"), "the pipeline needs no automata"
