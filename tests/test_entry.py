"""The entry lists the engine's queries whatever is missing of the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
from factorloom import catalog
assert e.queries().keys() == catalog.QUERIES.keys() and e.oracle_sql().keys() == catalog.ORACLES.keys() and len(e.queries()) > 100
"""


def test_blocked_imports():
    for name in ("public_tokenizers", "factorloom.llm", "tokenizers_that_are_not_there"):
        code = BLOCK.format(name=name)
        if name == "tokenizers_that_are_not_there":
            code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.queries().keys() >= e.oracle_sql().keys()"
        done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
