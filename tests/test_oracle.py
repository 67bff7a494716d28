"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    check(spark, duck, FOLDER, name)


@pytest.mark.parametrize("name", ["j19_first_iou", "j3_caption_items", "l2_best_box", "p19_check_pairs", "j18_pair_scores", "change_results", "t5_sessions"])
def test_query_on_more_rows(spark, name):
    # ties and open windows that the smallest tables do not have
    folder = FOLDER.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    check(spark, con, folder, name)


def check(spark, duck, folder, name):
    frame = entry.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    assert rows == wanted


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"all", "presence", "comp", "rural_urban", "count"} == {r["type"] for r in rows}
