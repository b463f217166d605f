import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == '{block}' or name == '{block}':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') for q in e.queries()))
"""


@pytest.mark.parametrize("block", ["sentencepiece", "corpus_pipeline", "stridemill.llm"])
def test_the_rest_works_without_a_library_of_the_corpus_part(block):
    done = subprocess.run([sys.executable, "-c", PROGRAM.replace("{block}", block)], capture_output=True, text=True, cwd=ROOT, timeout=120)
    queries, oracles, corpus = map(int, done.stdout.split())
    assert queries == oracles >= 89 and corpus == 0
