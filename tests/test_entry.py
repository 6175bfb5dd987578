"""The rest of the repository imports and registers its queries without the removable parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [["tessera/llm"], ["tessera/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_removable_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    gone = [g for g in gone if (copy / g).exists()]
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink()
    done = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "'flagship'" in done.stdout
    assert ("'pipeline'" in done.stdout) == ((copy / "corpus_pipeline.py").exists() and (copy / "tessera/llm").exists())
    assert ("op1_" in done.stdout) == (copy / "tessera/llm").exists()


def test_faults_of_removable_parts_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
