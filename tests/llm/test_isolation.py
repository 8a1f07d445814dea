"""Without this subpackage and its tests the rest imports, registers its queries and is tested."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import __spark_entry__ as entry
names = set(entry.queries())
assert names and names == set(entry.oracle_sql()) and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env=env, capture_output=True, text=True, timeout=600)
    done = run("-c", SCRIPT)
    assert done.returncode == 0, done.stderr[-2000:]
    # every module of tests is collected; one with Spark, streams and shared tables runs
    done = run("-m", "pytest", "--collect-only", "-q", "tests")
    assert done.returncode == 0, done.stdout[-2000:]
    done = run("-m", "pytest", "-q", "tests/test_streaming.py", "-k", "live_activity")
    assert done.returncode == 0, done.stdout[-2000:]
