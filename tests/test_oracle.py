"""Every query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.01"
from driftpanel.checks.oracle import ORACLES  # noqa: E402
from driftpanel.checks.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got, want = canonical(got), canonical(want)
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert {c: got[c].dtype.kind for c in got} == {c: want[c].dtype.kind for c in want}
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(ORACLES[name]).df())


def test_every_query_is_covered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 6
