"""The driver's entry without the corpus subpackage, which may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'matmul' in q, any(k.startswith('op') or k == 'pipeline' for k in [*q, *s]))"


@pytest.mark.parametrize("gone", [["quadlake/llm"], ["quadlake/llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_package(tmp_path, gone):
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        p = to / g
        if p.is_dir():
            shutil.rmtree(p)
        elif p.exists():
            p.unlink()
    got = subprocess.run([sys.executable, "-c", ASK], cwd=to, capture_output=True, text=True, check=True)
    n, with_sql, there, odd = got.stdout.split()
    assert int(n) >= 63 and int(with_sql) >= 61 and there == "True" and odd == "False"
