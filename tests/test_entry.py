"""The entry without the training-data operators, or without what they need."""

import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{absent!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 150 and set(entry.oracle_sql()) <= names
print("training", any(n.startswith("op") for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("absent", ["caseward.llm", "corpus_pipeline", "public_tokenizers", "regress"])
def test_entry_works_without_them(absent):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if absent == "regress" and not os.path.exists(f"{root}/corpus_pipeline.py"):
        pytest.skip("the training-data operators were taken out")
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, absent=absent)], capture_output=True, text=True, timeout=120)
    whole = absent == "regress"
    assert f"training {whole} {whole}" in done.stdout, done.stderr[-2000:]
