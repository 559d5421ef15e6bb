"""The driver's entry points, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    (tmp_path / "quillstone").mkdir()
    for p in (REPO / "quillstone").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quillstone" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'latest_restated_ttm' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)
