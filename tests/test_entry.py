"""The driver contract, with and without the optional modules."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
for name in {absent!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = entry.queries()
assert set(entry.oracle_sql()) <= set(names)
print(len(names), any(n.startswith("op") for n in names), "pipeline" in names)
"""


def imported(absent):
    done = subprocess.run([sys.executable, "-c", WITHOUT.format(absent=absent)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_without_the_optional_modules():
    n, ops, pipeline = imported(["braid.llm", "corpus_pipeline"])
    assert int(n) > 100 and (ops, pipeline) == ("False", "False")


def test_a_fault_inside_a_module_is_not_hidden():
    done = subprocess.run([sys.executable, "-c", "import sys; sys.modules['numpy'] = None; import __spark_entry__"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0
