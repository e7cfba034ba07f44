"""The entry point without the training-data operators."""

import os
import shutil
import subprocess
import sys

from meshlark.plans import registry

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
LISTS = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    env = {**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-B", "-c", LISTS], cwd=folder, env=env, capture_output=True, text=True, check=True, timeout=120)
    return [set(line.split()) for line in done.stdout.splitlines()]


def copy(folder, *left_out):
    shutil.copytree(ROOT, folder, ignore=lambda d, found: [f for f in found if f in (".git", "__pycache__", *left_out)])
    return folder


def test_without_the_training_data_operators(tmp_path):
    plain = [set(registry.queries()), set(registry.oracle_sql())]
    assert names(copy(tmp_path / "both", "llm", "corpus_pipeline.py")) == plain
    assert names(copy(tmp_path / "package", "llm")) == plain
    emptied = copy(tmp_path / "emptied", "llm")
    os.makedirs(emptied / "meshlark" / "llm" / "__pycache__")
    assert names(emptied) == plain


def test_a_broken_operator_is_not_hidden(tmp_path):
    broken = copy(tmp_path / "broken")
    if not os.path.isdir(broken / "meshlark" / "llm"):
        os.makedirs(broken / "meshlark" / "llm")
        (broken / "meshlark" / "llm" / "__init__.py").write_text("")
    (broken / "meshlark" / "llm" / "plans.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-B", "-c", LISTS], cwd=broken, capture_output=True, timeout=120).returncode != 0
