"""The rest of the repository stands alone where the subpackage llm has been removed, with corpus_pipeline.py or without."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = (
    "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
    "assert 'visible_page' in q and not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in [*q, *o]); print(len(q), len(o))"
)


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_without_llm(tmp_path, keep_pipeline):
    skip = shutil.ignore_patterns("llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(os.path.join(ROOT, "weft"), tmp_path / "weft", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)) and (keep_pipeline or name != "corpus_pipeline.py"):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
