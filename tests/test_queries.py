"""Every query against its DuckDB form, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from barwright.plans.catalog import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") else str(v)
    return sorted([tuple(value(v) for v in row) for row in df.itertuples(index=False)], key=str)


SAMPLE = ["pre_02", "pre_08", "pre_10", "mom_02", "mom_10", "trd_06", "trd_07", "vol_13", "vlm_08", "cnd_14", "tim_01", "tre_08", "mrv_08", "vle_02", "str_e7", "sta_02", "sta_04", "met_01", "met_02", "par_03", "boo_01", "wfo_02", "join_02", "str_01", "eng_05", "pre_01_issues", "pre_13_pipeline", "pre_14_session", "src_02", "src_03_files", "str_05", "met_03_stability", "sta_09_spearman", "rpt_06_session", "snk_01_report", "eng_05_overview"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry_and_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
