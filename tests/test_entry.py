"""The driver contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parents[1]


def test_names():
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert sql <= names and "q00_flagship" in names


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')]; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't there")
def test_flagship(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["l_returnflag", "n", "avg_quantity"] and found.count() == 3
