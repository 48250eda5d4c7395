"""The entry module with and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_without_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "swathframe", tmp_path / "swathframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    left = names(tmp_path)
    assert "coverage_polygons" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]


def test_whole():
    assert "coverage_polygons" in names(ROOT)


def test_flagship(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
