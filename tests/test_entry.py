"""The entry without the training-data operators, or without a library that they need."""

import subprocess
import sys

import pytest

ROOT = __file__.rsplit("/tests/", 1)[0]


@pytest.mark.parametrize("missing", ["spanloom.llm", "xxhash", "corpus_pipeline"])
def test_queries_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    n, n_sql, pipeline = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) >= int(n_sql) >= 60 and pipeline == "False"
