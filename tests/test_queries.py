import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hushframe import catalog
from hushframe.plans import running

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_hourly_counts_late_files(spark, tmp_path):
    days = ["2024-06-01", "2024-01-01", "2024-06-02", "2023-01-01"]  # over 60 days back and forth
    folder = tmp_path / "events.parquet"
    for i, day in enumerate(days):
        duckdb.sql(f"SELECT TIMESTAMP '{day} 10:20:00' AS ts, 'view' AS event_type FROM range({i + 1})").write_parquet(str(tmp_path / f"{i}.parquet"))
        folder.mkdir(exist_ok=True)
        os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
        os.rename(tmp_path / f"{i}.parquet", folder / f"{i}.parquet")
    found = running.hourly(spark, str(tmp_path), most_files=1).collect()
    assert sorted(r["n"] for r in found) == [1, 2, 3, 4]


def test_entry(spark):
    assert entry.entry(spark).count() == 200
