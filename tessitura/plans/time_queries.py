"""Queries of dates and times in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import moments
from tessitura.functions.rewriting import let
from tessitura.plans import normalizer
from tessitura.plans.queries import query, read, text_of

#: What is written, in standard form, and the moment as SQL. n: 1 to 9, d: 1 to 28, h: 1 to 12, day and ts: of the row.
SAID = [
    ("{day}", "{day}", "date_trunc('day', ts)"),
    ("{d} Mac 2021", "{d} Mac 2021", "make_date(2021, 3, d)"),
    ("Mei {d}", "Mei {d}", "make_date(year(ts), 5, d)"),
    ("{n} minggu lepas", "{n} minggu lalu", "ts - to_days(7 * n)"),
    ("{n} bulan lalu", "{n} bulan lalu", "ts - to_months(n)"),
    ("{n} minit lps", "{n} minit lalu", "ts - to_minutes(n)"),
    ("skrg ni", "sekarang ni", "ts"),
    ("dlm {n}jam", "dlm {n}jam", "ts + to_hours(n)"),
    ("dalam {n}hri", "dalam {n}hari", "ts + to_days(n)"),
    ("esk", "esok", "ts + to_days(1)"),
    ("kelmarin", "kelmarin", "ts - to_days(1)"),
    ("{n} thun dpn", "{n} tahun depan", "ts + to_years(n)"),
    ("{h}.30 ptg", "{h}:30 PM", "date_trunc('day', ts) + to_hours(h % 12 + 12) + to_minutes(30)"),
    ("pkul {h}", "pukul {h}", "date_trunc('day', ts) + to_hours(h)"),
    ("{h}:30 2021-03-04", "{h}:30 2021-03-04", "TIMESTAMP '2021-03-04' + to_hours(h) + to_minutes(30)"),
    ("2021-03-04 {h}:30", "2021-03-04 {h}:30", "TIMESTAMP '2021-03-04' + to_hours(h) + to_minutes(30)"),
    ("pukul {h} 4 Mac 2021", "pukul {h} 4 Mac 2021", "TIMESTAMP '2021-03-04' + to_hours(h)"),
    ("4 Mac 2021 pukul {h}", "4 Mac 2021 pukul {h}", "TIMESTAMP '2021-03-04' + to_hours(h)"),
    ("{h}am semalam", "{h}am semalam", "date_trunc('day', ts) - to_days(1) + to_hours(h % 12)"),
    ("smalam {h}:05", "semalam {h}:05", "date_trunc('day', ts) - to_days(1) + to_hours(h) + to_minutes(5)"),
    ("pukul {h} esok", "pukul {h} esok", "date_trunc('day', ts) + to_days(1) + to_hours(h)"),
    ("esok pukul {h}", "esok pukul {h}", "date_trunc('day', ts) + to_days(1) + to_hours(h)"),
]
FIELDS = {"n": "event_id % 9 + 1", "d": "event_id % 28 + 1", "h": "event_id % 12 + 1"}


def filled(template: str, day: str) -> str:
    """A template as SQL that Spark and DuckDB read alike."""
    out = template.replace("'", "''")
    for name, value in {**FIELDS, "day": day}.items():
        out = out.replace("{" + name + "}", f"', CAST({value} AS STRING), '" if name != "day" else f"', {value}, '")
    return f"concat('{out}', '')"


def told(which: int, day: str) -> str:
    """SQL of the template with number ``which``, or of all by ``event_id``."""
    return "CASE " + " ".join(f"WHEN event_id % {len(SAID)} = {i} THEN {filled(s[which], day)}" for i, s in enumerate(SAID)) + " END"


def moment_sql() -> str:
    return "CASE " + " ".join(f"WHEN k = {i} THEN CAST({s[2]} AS TIMESTAMP)" for i, s in enumerate(SAID)) + " END"


@query(
    f"WITH e AS (SELECT event_id, ts, event_id % {len(SAID)} AS k, CAST({FIELDS['n']} AS INT) AS n, CAST({FIELDS['d']} AS INT) AS d, CAST({FIELDS['h']} AS INT) AS h, "
    + told(1, "strftime(ts, '%Y-%m-%d')").replace("STRING", "VARCHAR")
    + f" AS expression FROM events) SELECT event_id, expression, strftime({moment_sql()}, '%Y-%m-%d %H:%M:%S') AS moment FROM e"
)
def moments_in_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of time of all kinds in composed notes, with their moments."""
    events = read(spark, sf_dir, "events").where("event_id IS NOT NULL")
    note = F.concat(F.lit("jumpa "), F.expr(told(0, "date_format(ts, 'yyyy-MM-dd')")), F.lit(" ya"))
    found = events.select("event_id", F.explode(moments.moments(note, "ts")).alias("expression", "at"))
    return found.select("event_id", "expression", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query()
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All expressions of time and amounts of money in whole documents, seen from noon of the first day of 2024."""
    found = read(spark, sf_dir, "documents").select("doc_id", normalizer.entities("text", F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("e"))
    shown = lambda m, v: F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("key"), v(x["value"]).alias("value"))))))
    return found.select("doc_id", shown("e.dates", lambda v: F.date_format(v, "yyyy-MM-dd HH:mm:ss")).alias("dates"), shown("e.money", text_of).alias("money"))


@query(
    "WITH d AS (SELECT event_id, ts, event_id % 9 + 1 AS n, ['minggu', 'bulan', 'tahun', 'hari', 'jam', 'minit', 'saat'][CAST(event_id % 7 AS INT) + 1] AS unit, event_id % 3 AS way FROM events), "
    "s AS (SELECT *, CASE WHEN way = 0 THEN -n ELSE n END AS k FROM d) "
    "SELECT event_id, strftime(CASE unit WHEN 'minggu' THEN ts + to_days(CAST(7 * k AS INT)) WHEN 'bulan' THEN ts + to_months(CAST(k AS INT)) WHEN 'tahun' THEN ts + to_years(CAST(k AS INT)) WHEN 'hari' THEN ts + to_days(CAST(k AS INT)) "
    "WHEN 'jam' THEN ts + to_hours(k) WHEN 'minit' THEN ts + to_minutes(k) ELSE ts + to_seconds(CAST(k AS DOUBLE)) END, '%Y-%m-%d %H:%M:%S') AS moment FROM s"
)
def relative_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit before and after an explicit moment."""
    n, unit = "CAST(event_id % 9 + 1 AS STRING)", "array('minggu', 'bulan', 'tahun', 'hari', 'jam', 'minit', 'saat')[CAST(event_id % 7 AS INT)]"
    said = F.expr(f"CASE event_id % 3 WHEN 0 THEN concat({n}, ' ', {unit}, ' lalu') WHEN 1 THEN concat({n}, ' ', {unit}, ' depan') ELSE concat('dalam ', {n}, {unit}) END")
    return read(spark, sf_dir, "events").select("event_id", let(said, lambda t: F.date_format(moments.moment_of(t, F.col("ts")), "yyyy-MM-dd HH:mm:ss")).alias("moment"))
