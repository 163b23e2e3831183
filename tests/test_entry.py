"""The entry module: registered queries, and life without the optional folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[:3] == ["source", "company", "signal"] and frame.count() > 0


def test_sql_names_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_folders(tmp_path):
    for part in ("postpulse", "__spark_entry__.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] == 'op' for n in q))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""}
    )
    assert done.returncode == 0, done.stderr
    count, has_operators = done.stdout.split()
    assert int(count) > 60 and has_operators == "False"
