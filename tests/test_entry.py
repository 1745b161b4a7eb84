"""The driver's entry points, with and without the subpackage llm."""

import subprocess
import sys

from conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm(tmp_path):
    """As after both llm folders and corpus_pipeline.py are deleted."""
    for name in ("__spark_entry__.py", "heddlework"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    if (tmp_path / "heddlework/llm").exists():
        (tmp_path / "heddlework/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') or x == 'pipeline' for x in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_llm():
    found = subprocess.run(["grep", "-rnE", r"(from|import) .*\bllm\b", f"{ROOT}/heddlework", "--include=*.py"], capture_output=True, text=True).stdout
    assert not [line for line in found.splitlines() if "/heddlework/llm/" not in line]
