"""The registry in a copy of the tree without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_llm(tmp_path, with_pipeline):
    keep = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "pluviogrid", tmp_path / "pluviogrid", ignore=keep)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
