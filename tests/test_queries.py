"""Every query with SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from parallaxis import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")


def tidy(rows, cols):
    out = []
    for r in rows:
        out.append(tuple(round(float(r[c]), 9) if isinstance(r[c], float) else str(r[c]) for c in cols))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(core.oracle_sql()[name])
    got = core.queries()[name](spark, str(SF))
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert tidy([r.asDict() for r in got.collect()], cols) == tidy([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_others_have_rows(spark, name):
    assert core.queries()[name](spark, str(SF)).count() > 0


def test_resized_rasters_are_not_broadcast(spark):
    got = core.queries()["mask_resize_nearest"](spark, str(SF))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
