import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_queries_without_the_optional_files(tmp_path):
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{REPO}/twinmark", tmp_path / "twinmark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    core = listed(tmp_path)
    assert "evidence_results" in core and "pipeline" not in core
    (tmp_path / "twinmark" / "llm").mkdir()  # an empty folder left behind
    assert listed(tmp_path) == core


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["status", "n"] and found.where("status = 'TOTAL'").first().n > 0
