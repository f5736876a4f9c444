"""The entry module with and without the training-data operators."""

import subprocess
import sys

import pytest

from tests.conftest import ROOT

HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from hexflow.plans import registry
print(set(registry.QUERIES) <= set(e.queries()), set(registry.ORACLES) <= set(e.oracle_sql()), any(q.startswith("op1_") for q in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("names", [("hexflow.llm", "corpus_pipeline"), ("xxhash",), ("corpus_pipeline",)])
def test_engine_queries_stay_where_operators_cannot_be_imported(names):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=names, root=str(ROOT))], capture_output=True, text=True, check=True).stdout.split()
    assert out[:2] == ["True", "True"] and out[3] == "False" and (out[2] == "False" or names == ("corpus_pipeline",))
