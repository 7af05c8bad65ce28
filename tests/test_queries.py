"""Every registered query outside the optional subpackage against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.plans import ORACLE_SQL, QUERIES, flagship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(d: pd.DataFrame) -> list[str]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        if v is None or pd.isna(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.4f}"
        return str(v)[:19]

    return sorted("|".join(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["s_first_signups", "s_daily_windows", "s_alert_cooldown", "s_smoothed"])
def test_streams_do_not_depend_on_the_files(spark, db, tmp_path, name):
    events = pq.read_table(f"{FOLDER}/events.parquet").to_pandas().sample(frac=1, random_state=5)
    (tmp_path / "events.parquet").mkdir()
    for k in range(40):
        pq.write_table(pa.Table.from_pandas(events[k::40], preserve_index=False), tmp_path / "events.parquet" / f"part-{k}.parquet", coerce_timestamps="us")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(db.sql(ORACLE_SQL[name]).df())


def test_flagship(spark):
    assert flagship(spark, FOLDER).count() > 0
