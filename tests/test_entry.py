import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "nearfield", tmp_path / "nearfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') for n in q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, within, any_llm = said.stdout.split()
    assert int(count) > 80 and (within, any_llm) == ("True", "False"), said.stderr


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
