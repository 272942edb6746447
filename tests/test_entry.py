"""The entry module with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
ALONE = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("parlance.llm"):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") or k == "pipeline" for k in e.queries()))
"""


def test_alone():
    out = subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 60 and int(out[1]) >= 60 and out[2] == "False"


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
