"""The entry without the optional subpackage, and without a library that it needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("how", ["folders deleted", "library absent"])
def test_without_the_subpackage(tmp_path, how):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.txt", "*.md", "*.json"))
    if how == "folders deleted":
        shutil.rmtree(copy / "citytables/llm", ignore_errors=True)
        shutil.rmtree(copy / "tests/llm", ignore_errors=True)
        if (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
    else:
        (copy / "ahocorasick.py").write_text("raise ModuleNotFoundError(name='ahocorasick')\n")
        (copy / "regex.py").write_text("raise ModuleNotFoundError(name='regex')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'bbox_query' in q; assert not any(n.startswith('op') and n[2].isdigit() for n in q), q; print('fine')"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
