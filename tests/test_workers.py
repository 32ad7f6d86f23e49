"""Python workers need no copy of the package: a session started elsewhere, without PYTHONPATH, runs the user functions."""
from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from causal_panel.session import local_session
spark = local_session("elsewhere", cpus=4)
for key in ("C4_online_ridge", "C8_season_ahead_ridge", "J17_fit_odds"):
    key = next(k for k in entry.queries() if k.startswith(key[:4]))
    assert entry.queries()[key](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def test_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
