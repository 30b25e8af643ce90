import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_corpus_operators(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *["corpus_pipeline.py"] * (not pipeline))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert 'resolve' in e.queries() and 'resolve' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


@pytest.mark.skipif(not (ROOT / "fieldloom" / "llm").exists(), reason="the corpus operators are taken out")
def test_a_missing_library_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n import __spark_entry__\nexcept ImportError as e:\n assert e.name == 'xxhash'\nelse:\n raise AssertionError"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "fieldloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"fieldloom[. ]+(import )?llm", path.read_text()), path
