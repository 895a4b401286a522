"""What stands on its own: the engine without the corpus subpackage, and places over many ranges."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from veilgrid.functions.ranking import with_place
from veilgrid.plans import catalog

ROOT = Path(__file__).resolve().parents[2]


def test_the_entry_works_without_the_corpus_subpackage(tmp_path):
    for name in ("veilgrid", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-2:] == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "veilgrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "veilgrid.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_places_are_one_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    rows = with_place(df.repartition(7), [F.col("v") % 10, F.col("v")]).collect()
    expected = sorted(range(1000), key=lambda v: (v % 10, v))
    assert [r.v for r in sorted(rows, key=lambda r: r.place)] == expected
    assert sorted(r.place for r in rows) == list(range(1, 1001))
