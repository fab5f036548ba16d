"""The entry without the optional training-data files."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"


def _shown(at: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", SHOW], cwd=at, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}).stdout.split()


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_works_without_the_training_data_files(tmp_path, pipeline_left):
    shutil.copytree(ROOT / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_left and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    n, sql, operators, pipeline = _shown(tmp_path)
    assert int(n) >= 50 and int(sql) >= 50 and operators == pipeline == "False"


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "palimpsest").parts:
            assert "palimpsest.llm" not in path.read_text(), path
