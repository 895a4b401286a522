"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from veilgrid.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def oracle():
    if not DATA.exists():
        pytest.skip("no data tables here")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, oracle, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    relation = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    expected = Counter(repr([plain(row[i]) for i in at]) for row in relation.fetchall())
    assert Counter(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    compare(spark, oracle, name)


#: Fixpoints run many small jobs; with adaptive execution on they are tested above.
FIXPOINTS = ("T02", "T03", "T04", "T06_chain", "T07", "T20", "T22", "T01", "I01", "I04", "T19_inherited")


@pytest.mark.parametrize("name", [n for n in sorted(catalog.oracle_sql()) if not n.startswith(FIXPOINTS)])
def test_query_equals_sql_without_adaptive_execution(spark, oracle, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        compare(spark, oracle, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_match_the_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
