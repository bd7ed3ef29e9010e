"""The entry points also work without the optional part."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_optional_folders(tmp_path):
    """A copy of the repository without them has all other queries; corpus_pipeline.py may still be there."""
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(HERE, copy, ignore=skip)
    ask = "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    import __spark_entry__  # noqa: F401
    from querybook import base

    assert out.stdout.strip() == f"{len(base.QUERIES)} []"
