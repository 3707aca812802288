import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys


class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "tidelog.llm" or name.startswith("tidelog.llm."):
            raise ModuleNotFoundError(name)


sys.meta_path.insert(0, Gone())
import __spark_entry__ as e

names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
assert not any(m.startswith("tidelog.llm") for m in sys.modules)
"""


def test_the_rest_works_without_the_llm_folder():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tidelog").parts:
            assert "llm" not in path.read_text()
