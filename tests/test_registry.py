"""The registry stands with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_without_corpus(tmp_path):
    for p in ("panelspark", "__spark_entry__.py"):
        source = ROOT / p
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / p)
    shutil.rmtree(tmp_path / "panelspark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
