"""The driver's module without the optional parts."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_operators(tmp_path, without):
    def left_out(folder, names):
        return [name for name in names if name in without or name in (".git", "__pycache__")]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=left_out)
    code = (
        "import __spark_entry__ as e; names = e.queries(); assert e.oracle_sql().keys() <= names.keys();"
        "print(len(names), any(n.startswith('op1') or n == 'pipeline' for n in names))"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    count, extra = run.stdout.split()
    assert int(count) > 100 and extra == "False"
