"""The entry loads what it can."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
for name in {missing!r}:
    sys.modules[name] = None                    # importing it raises ImportError
import __spark_entry__ as e
from orderflow.plans.registry import QUERIES
print(len(e.queries()), len(QUERIES), all(k in e.queries() for k in QUERIES), set(e.oracle_sql()) <= set(e.queries()))
"""


def loaded(*missing: str) -> list[str]:
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", SCRIPT.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, check=True)
    return run.stdout.split()


def test_entry_without_a_dependency_of_the_optional_operators():
    for name in ("public_tokenizers", "zstandard", "sentencepiece", "orderflow.llm.registry", "corpus_pipeline"):
        found, core, whole, oracle = loaded(name)
        assert found in (core, loaded()[0]) and whole == oracle == "True"
    assert loaded("public_tokenizers")[0] == loaded("public_tokenizers")[1]


def test_entry_adds_to_the_core_queries():
    found, core, whole, _ = loaded()
    assert int(found) >= int(core) and whole == "True"
