"""The entry without the training-data operators, or without a library that only they need."""

import os
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys, warnings
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(k.startswith("op") and "_" in k and k[2:].split("_")[0].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries()) and "pipeline" not in e.queries()
"""


@pytest.mark.parametrize("name", ["marlstone.llm", "corpus_pipeline", "xxhash", "zstandard"])
def test_the_rest_works_without(name):
    uses = subprocess.run(["grep", "-rlE", rf"^(import|from) {name}\b", f"{TOP}/marlstone/llm"], capture_output=True, text=True).stdout
    if "." not in name and name != "corpus_pipeline" and not uses:
        pytest.skip("nothing imports it at its top")
    subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=TOP, check=True, env=os.environ | {"PYTHONPATH": TOP, "PYTHONWARNINGS": "ignore"})


def test_other_missing_modules_are_errors():
    code = BLOCK.format(name="numpy")
    assert subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, env=os.environ | {"PYTHONPATH": TOP}).returncode
