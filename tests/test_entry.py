import os
import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT

TABLES = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "trade_exhaustive_counts" in entry.queries()


def test_entry_runs(spark):
    if os.path.isdir(TABLES):
        assert sum(r.n for r in entry.entry(spark).collect()) > 0


def test_imports_without_the_text_operators(tmp_path):
    """The package and its entry work where the optional folder and file are not there."""
    for name in os.listdir(ROOT):
        if name in ("tidegraph", "__spark_entry__.py"):
            os.system(f"cp -r {ROOT}/{name} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/tidegraph/llm")
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries()); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr
