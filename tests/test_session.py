"""The package reaches workers that do not have it on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from plumbline.session import build_session
from plumbline.operators.spacing import keep_spaced
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
rows = spark.sql("SELECT 'a' k, id, timestamp_seconds(id * 60) at FROM range(40)")
print("kept", keep_spaced(rows, ["k"], "at", 900_000, tie="id").count())
"""


def test_python_code_is_shipped(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "kept 3" in done.stdout, done.stderr[-2000:]
