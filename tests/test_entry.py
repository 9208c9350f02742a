"""The driver's entry module, whole and without its optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from statelattice.plans import catalogue


@pytest.mark.parametrize("gone", [["statelattice/llm", "tests/llm", "corpus_pipeline.py"], ["statelattice/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), *q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, _, *names = done.stdout.split()
    assert set(catalogue.QUERIES) <= set(names) and "pipeline" not in names
    assert (int(n) == len(catalogue.QUERIES)) == (not any(name.startswith("op") for name in names))


def test_other_import_errors_are_raised(tmp_path, monkeypatch):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    code = "import __spark_entry__ as e; e.queries()"
    done = subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": f"{tmp_path}:{ROOT}", "PATH": "/usr/bin:/bin"}, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
