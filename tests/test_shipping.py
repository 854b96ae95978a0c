"""The package reaches executors that do not have it installed."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from listwright.session import build_session
spark = build_session("ship", **{{"spark.master": "local[2]", "spark.ui.enabled": "false"}})
from listwright.functions.html import html_to_text
from pyspark.sql import functions as F
print(spark.createDataFrame([("<p>a</p><p>b</p>",)], "h string").select(html_to_text(F.col("h"))).first()[0].split())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("['a', 'b']"), run.stderr[-2000:]
