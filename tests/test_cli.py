"""The command line lists every query of the library (the text operators,
which nothing else imports, are registered in __spark_entry__.py only)."""

import subprocess
import sys

from suite import ROOT


def test_cli_lists_all_queries():
    from vitrine import catalog

    out = subprocess.run([sys.executable, "-m", "vitrine", "list"], cwd=ROOT, capture_output=True, text=True,
                         timeout=120, check=True).stdout.splitlines()
    names = {line.split()[0] for line in out if line.strip()}
    assert names == set(catalog.queries())
    oracle = {line.split()[0] for line in out if line.split()[1] == "oracle"}
    assert oracle == set(catalog.oracle_sql())
