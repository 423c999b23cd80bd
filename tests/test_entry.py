"""The entry module imports and works without a session and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""}).stdout.split()


def copied(target, *names_):
    for name in names_:
        source = os.path.join(ROOT, name)
        if os.path.exists(source):
            (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, target / name)


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_a_session(tmp_path, pipeline):
    """The training-data folder away, with the pipeline's file there or not; remains of it tell nothing."""
    full = names(ROOT)
    copied(tmp_path, "patchlane", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else []))
    shutil.rmtree(tmp_path / "patchlane/llm", ignore_errors=True)
    (tmp_path / "patchlane/llm/__pycache__").mkdir(parents=True)
    assert names(tmp_path) == [n for n in full if not n.startswith("op") and n != "pipeline"]


def test_an_error_inside_an_optional_module_is_not_hidden(tmp_path):
    copied(tmp_path, "patchlane", "__spark_entry__.py")
    (tmp_path / "patchlane/llm").mkdir(exist_ok=True)
    for name in ("__init__.py", "queries.py"):
        (tmp_path / "patchlane/llm" / name).write_text("import no_such_dependency\n")
    with pytest.raises(subprocess.CalledProcessError):
        names(tmp_path)
