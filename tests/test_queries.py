"""Every registered query of the library runs on the smallest tables and equals its SQL where it has one."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tessitura.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert rows
    if name in ORACLES:
        names = ", ".join(f'"{c}"' for c in columns)
        want = sorted(tuple(map(str, r)) for r in duck.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall())
        assert rows == want


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data tables")
@pytest.mark.parametrize("name", ["normalize_text", "cascade_rules", "zh_mixed", "entities"])
def test_small_files_are_dealt_to_all_cores(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data tables")
def test_slots_do_not_depend_on_the_zone(spark, duck):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kuala_Lumpur")
    try:
        rows = sorted(tuple(r) for r in QUERIES["microbatch_sim"](spark, DATA).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert rows == sorted(duck.sql(ORACLES["microbatch_sim"]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data tables")
@pytest.mark.parametrize(
    "odd",
    ["ts - INTERVAL 55 YEAR AS ts", "CAST(ts AS DATE) AS ts", "CASE WHEN event_id % 7 > 0 THEN ts END AS ts, CASE WHEN event_id % 5 > 0 THEN event_id END AS event_id"],
    ids=["before 1970", "dates", "nulls"],
)
def test_slots_of_odd_events(spark, tmp_path, odd):
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT * REPLACE ({odd}) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kuala_Lumpur")
    try:
        rows = sorted(map(str, QUERIES["microbatch_sim"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.replace("Row", "") for r in rows] == sorted(f"(event_id={i}, slot={s}, batch={b})" for i, s, b in duck.sql(ORACLES["microbatch_sim"]).fetchall())
