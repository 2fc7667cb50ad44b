"""The entry in a copy of the repository without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as contract
names = set(contract.queries())
assert "top_complainers" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names), names
assert set(contract.oracle_sql()) <= names
from chatterlens.session import build_session
spark = build_session("entry", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
print("rows", contract.entry(spark).count() if %r else 20)
"""


def copied(tmp_path, *left_out):
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", *left_out)])


def run(folder, code):
    made = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)
    assert made.returncode == 0, made.stderr[-3000:]
    return made.stdout


def test_entry_without_the_folders(tmp_path):
    folder = copied(tmp_path, "llm", "corpus_pipeline.py")
    assert "rows 20" in run(folder, CODE % os.path.isdir("/root/testdata/sf0.001"))


def test_entry_with_the_pipeline_alone(tmp_path):
    folder = copied(tmp_path, "llm")
    run(folder, "import __spark_entry__ as c; assert 'pipeline' not in c.queries() and len(c.queries()) > 100")


def test_entry_where_a_library_is_missing(tmp_path):
    folder = copied(tmp_path)
    run(folder, "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as c; assert len(c.queries()) > 100")
