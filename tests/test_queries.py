import glob
import os

import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import oracles, queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, db, tmp_path, name):
    queries.queries()[name](spark, sf).write.parquet(str(tmp_path / "out"))
    got = f"'{tmp_path}/out/*.parquet'"
    assert db.execute(f"select count(*) from {got}").fetchall()[0][0] > 0
    sql = oracles.oracle_sql().get(name)
    if sql:
        db.execute(f"create or replace table want as {sql}")
        cols = ", ".join(sorted(r[0] for r in db.execute("describe want").fetchall()))
        assert cols == ", ".join(sorted(r[0] for r in db.execute(f"describe select * from {got}").fetchall()))
        for a, b in (("want", got), (got, "want")):
            assert db.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "word", "freq", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
