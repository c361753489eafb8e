"""The entry works where the optional text operators are taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"


def test_entry_without_text_operators(tmp_path):
    for name in ("eventlake", "suite"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    # with the pipeline file left behind, and then without it
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    for _ in range(2):
        subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, check=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
