"""Each query against its SQL in DuckDB, over the smallest of the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from glyphmill.plans.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        found.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return found


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = rows(QUERIES[name](spark, str(TABLES)).toPandas())
    assert got[1] and got == rows(db.execute(ORACLES[name]).df())


def test_denoised_patterns_one_by_one(spark):
    from glyphmill.operators.glyphs import denoise

    got = QUERIES["denoise_patterns"](spark, str(TABLES)).collect()
    was = {r.vec_id: r.pattern for r in QUERIES["canonical_pattern"](spark, str(TABLES)).collect()}
    assert len(got) == len(was) and any(r.changed for r in got)
    assert all(r.pattern == denoise(was[r.vec_id], 2) and r.changed == (r.pattern != was[r.vec_id]) for r in got)
