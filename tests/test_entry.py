import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry works if the subpackage and its pipeline are deleted."""
    shutil.copy(f"{HOME}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{HOME}/tabloom", tmp_path / "tabloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and 'pipeline' not in n and set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
