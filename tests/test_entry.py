"""The registry: complete with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(top):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=top, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout.splitlines()
    return set(said[0].split()), set(said[1].split())


def test_imports_without_a_session_and_without_the_text_operators(tmp_path):
    whole, sql = names(ROOT)
    assert sql <= whole and len(whole) > 100
    shutil.copytree(ROOT / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    rest, rest_sql = names(tmp_path)
    assert rest == {n for n in whole if not n.startswith("op") and n != "pipeline"} and rest_sql <= rest


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "barloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_flagship(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() == 3 and "monotone" in got.columns
