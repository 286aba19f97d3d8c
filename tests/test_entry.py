"""The entry module without the optional training-data package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def names(folder):
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", CHECK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


def test_entry_imports_without_the_optional_package(tmp_path):
    """With the package gone, and with the pipeline module gone or left, the other queries stay."""
    for gone in (("llm",), ("llm", "pipeline")):
        copy = tmp_path / "-".join(gone)
        shutil.copytree(os.path.join(ROOT, "fundlens"), copy / "fundlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ("__spark_entry__.py", "corpus_pipeline.py"):
            if os.path.exists(os.path.join(ROOT, f)) and not (f[0] == "c" and "pipeline" in gone):
                shutil.copy(os.path.join(ROOT, f), copy)
        total, optional = names(copy)
        assert total > 80 and optional == 0
