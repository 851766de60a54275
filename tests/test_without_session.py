"""The queries can be listed before there is a session, as the check tool does."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
