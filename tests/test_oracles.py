"""Every registered query of the engine against its SQL, over whole small tables."""

import duckdb
import pandas as pd
import pytest

from trawl.plans.registry import QUERIES
from trawl.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(frame.columns)
    text = frame[cols].astype(object).where(frame[cols].notna(), None)
    return text.map(lambda v: str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).sort_values(cols).reset_index(drop=True)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))
