"""The registry without the training-data subpackage, as when its folders are deleted."""

import subprocess
import sys

from helpers import HERE

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ticketscope.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
names = set(e.queries())
assert "kpi" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", CODE, HERE + "/.."], check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(HERE).parent
    for path in root.rglob("*.py"):
        own = path.relative_to(root).as_posix()
        if own in ("__spark_entry__.py", "corpus_pipeline.py", "tests/test_entry.py") or "llm/" in own:
            continue
        assert "ticketscope.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), own
