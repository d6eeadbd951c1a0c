"""The entry point without the corpus operators' libraries."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_tokenizer_files():
    """A missing library of the corpus operators leaves all other queries in place."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True)
    n_queries, n_sql = map(int, out.stdout.split())
    assert n_queries == n_sql >= 135
