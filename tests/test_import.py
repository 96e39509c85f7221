import subprocess
import sys

from conftest import ROOT


def test_entry_points_import_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
