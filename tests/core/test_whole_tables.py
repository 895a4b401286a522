"""The full literal detector over whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from veilgrid.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name, table, key, text", [("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html")])
def test_all_detectors_find_what_the_sql_finds(spark, name, table, key, text):
    """Against the SQL of the fixture over the whole table; words beside a value only raise its confidence."""
    if not DATA.exists():
        pytest.skip("no data tables here")
    fixture = catalog.oracle_sql()["L16_all_detectors"]
    sql = f"WITH texts AS (SELECT {key} AS id, {text} AS text FROM '{DATA}/{table}.parquet'), {fixture[fixture.index('raw_lines AS') :]}"  # without the labels
    columns = ["line", "col", "data_type", "masked", "value_hash", "detector"]
    expected = duckdb.connect().sql(f"SELECT id, {', '.join(columns)}, confidence FROM ({sql})").fetchall()
    found = catalog.queries()[f"L16_all_detectors_{name}"](spark, str(DATA)).select(key, *columns, "confidence").collect()
    assert Counter(tuple(r)[:-1] for r in found) == Counter(r[:-1] for r in expected)
    least = {r[:-1]: r[-1] for r in expected}
    assert all(r.confidence >= least[tuple(r)[:-1]] for r in found)
    assert found or table == "pages"
