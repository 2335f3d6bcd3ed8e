"""Queries of single rules: of the cascade, of words and patterns, of files that are written and read again, and of streams that end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import chinese, numbers, signals, text, words
from tessitura.operators import lexicon, tokens
from tessitura.plans import cascade
from tessitura.plans import reference_sql as S
from tessitura.plans.queries import CHUNK, CONTEXT, query, read, spread, text_of
from tessitura.sources import readers, writers
from tessitura.streaming.chunks import END, chunk_stream

# --- the cascade, rule by rule ----------------------------------------------------------------------------
TWO = "CAST(c_custkey % 90 + 10 AS BIGINT)"  # 10 to 99
DIGITS = S.digits(f"CAST({TWO} AS VARCHAR)", numbers.DIGITS_MS)
#: What is written ({n}: a number of two digits, {w}: the customer's segment in lower case) and what is said, as SQL.
RULES = [
    ("#tag{n} hmm", f"'#tag' || {TWO} || ' hmm'"),
    ("@user{n} pergi", f"'@user' || {TWO} || ' pergi'"),
    ("a-{n}-z", f"'A sempang ' || {DIGITS} || ' sempang Z'"),
    ("A123456{n}", f"'A satu dua tiga empat lima enam ' || {DIGITS}"),
    ("ke-{n}", f"'ke' || ({S.cardinal_ms(TWO)})"),
    ("{n} - {n}", f"({S.cardinal_ms(TWO)}) || ' hingga ' || ({S.cardinal_ms(TWO)})"),
    ("tahun 19{n}-an", f"'tahun sembilan belas ' || ({S.cardinal_ms(TWO)}) || 'an'"),
    ("012{n}", f"'kosong satu dua ' || {DIGITS}"),
    ("{n} January", f"'ke' || ({S.cardinal_ms(TWO)}) || ' January'"),
    ("x{w}", "'tak ' || lower(c_mktsegment)"),
    ("Ali{n}", f"'Ali ' || ({S.cardinal_ms(TWO)})"),
    ("880101-14-56{n}", f"'lapan lapan kosong satu kosong satu satu empat lima enam ' || {DIGITS}"),
    ("q{n} {n}", f"'q' || {TWO} || ' ' || ({S.cardinal_ms(TWO)})"),
    ("pergi {w}", "'pergi ' || CASE lower(c_mktsegment) WHEN 'automobile' THEN 'kereta' WHEN 'building' THEN 'Building' WHEN 'household' THEN 'bolsa' ELSE lower(c_mktsegment) END"),
    ("Dr {n}%", f"'Doktor ' || ({S.cardinal_ms(TWO)}) || ' peratus'"),
    ("jom2 {n}hb", f"'jom-jom ' || ({S.cardinal_ms(TWO)}) || ' hari bulan'"),
    ("{n}.5k", f"({S.cardinal_ms(f'({TWO}) * 1000 + 500')})"),
]


def composed(column: str) -> str:
    """SQL that Spark runs: the text of each customer."""
    parts = []
    for i, (form, _) in enumerate(RULES):
        made = "concat('" + form.replace("{n}", "', CAST(c_custkey % 90 + 10 AS STRING), '").replace("{w}", "', lower(c_mktsegment), '") + "')"
        if form.startswith("jom2"):  # days of a month only
            made = "concat('jom2 ', CAST(c_custkey % 90 % 31 + 1 AS STRING), 'hb')"
        parts.append(f"WHEN {column} % {len(RULES)} = {i} THEN {made}")
    return "CASE " + " ".join(parts) + " END"


@query(
    "SELECT c_custkey, CASE "
    + " ".join(f"WHEN c_custkey % {len(RULES)} = {i} THEN {said if not form.startswith('jom2') else said.replace(TWO, 'CAST(c_custkey % 90 % 31 + 1 AS BIGINT)')}" for i, (form, said) in enumerate(RULES))
    + " END AS said FROM customer"
)
def cascade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the rules of the cascade read one by one; word lists, places, slang, scores and a speller are stated."""
    rules = cascade.Rules(
        english=lambda w: w.isin("furniture"), malay=lambda w: w.isin("machinery", "pergi"), place=lambda w: w.isin("building"), slang={"automobile": "kereta"},
        score=lambda w: F.when(w.rlike("^q"), 0.0).otherwise(1.0), spell=lambda w: F.when(w == "household", "bolsa").otherwise(w),
    )
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", F.expr(composed("c_custkey")).alias("said"))
    return cascade.speak(rows, "said", rules).select("c_custkey", "said")


# --- words and patterns -----------------------------------------------------------------------------------
@query(
    "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), t AS (SELECT string_split(p_name, ' ')[1] AS word, max(p_brand) AS value FROM part GROUP BY 1) "
    "SELECT word, coalesce(value, word) AS rewritten FROM w LEFT JOIN t USING (word)"
)
def rewrite_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts by a table of rewrites, of which the greatest counts."""
    part = read(spark, sf_dir, "part")
    found = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return lexicon.rewrite(found, part.select(F.get(F.split("p_name", " "), 0).alias("word"), F.col("p_brand").alias("value")))


CASES = "CASE word WHEN upper(left(word, 1)) || lower(substr(word, 2)) THEN 'title' WHEN lower(word) THEN 'lower' WHEN upper(word) THEN 'upper' ELSE 'as is' END"


@query(f"SELECT word, {CASES} AS form FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)")
def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case of every different word of the documents."""
    found = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return found.select("word", text.case_name("word").alias("form"))


@query("SELECT c_custkey, array_to_string(list_transform(string_split(concat('a ', c_custkey % 10, ' b1 ', c_mktsegment, ' z'), ' '), lambda w: CASE WHEN length(w) = 1 THEN upper(w) ELSE w END), ' ') AS said FROM customer")
def single_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one character in upper case."""
    source = F.concat(F.lit("a "), text_of(F.col("c_custkey") % 10), F.lit(" b1 "), F.col("c_mktsegment"), F.lit(" z"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.upper_singles(source).alias("said"))


@query("SELECT p_partkey, concat(string_split(p_name, ' ')[1], repeat('z', CAST(least(p_partkey % 6, 2) AS INT)), ' http://aaa.com 1000') AS squashed FROM part WHERE NOT ends_with(string_split(p_name, ' ')[1], 'z') AND NOT regexp_matches(string_split(p_name, ' ')[1], 'zzz')")
def squashed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a letter cut to two, but not in addresses and numbers."""
    first = F.get(F.split("p_name", " "), 0)
    source = F.concat(first, F.expr("repeat('z', cast(p_partkey % 6 as int))"), F.lit(" http://aaa.com 1000"))
    return read(spark, sf_dir, "part").where(~F.endswith(first, F.lit("z"))).select("p_partkey", words.squash_words(source).alias("squashed"))


@query("SELECT c_custkey, concat('联系 USER', c_custkey, ' at MAIL dot COM 谢谢') AS said FROM customer")
def email_in_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in Chinese text."""
    source = F.concat(F.lit("联系 user"), text_of(F.col("c_custkey")), F.lit("@mail.com 谢谢"))
    return chinese.normalize_chinese(read(spark, sf_dir, "customer").select("c_custkey", source.alias("said")), "said")


COUNTED = ("hashtag", "user", "tag", "emphasis", "censored", "parliament", "hijri_year", "hari_bulan")
MORE = ("repeat_puncts", "bracket", "day_in_date", "quotes", "allcaps")
NOTE = "' #tag-' || {id} || ' @ali_' || {id} || ' <b>x</b> *bold* f***k D.' || {id} || ' 1445H 12hb wow!!! (see ' || {id} || ') 3 March 2021 \"quoted ' || {id} || '\" IN CAPS now'"


def counts_sql() -> str:
    pattern = lambda k: (tokens.TOKENS.get(k) or tokens.MORE[k]).replace("(?<![#@$])", "").replace("'", "''")
    return ", ".join(f"CAST(len(regexp_extract_all(t, '{pattern(k)}')) AS BIGINT) AS {k}" for k in (*COUNTED, *MORE))


@query(f"SELECT p_partkey, {counts_sql()} FROM (SELECT p_partkey, p_name || {NOTE.format(id='p_partkey')} AS t FROM part)")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pattern of the catalogue occurs in part names with notes."""
    note = F.expr("p_name || " + NOTE.format(id="CAST(p_partkey AS STRING)"))
    rows = read(spark, sf_dir, "part").select("p_partkey", note.alias("t"))
    return rows.select("p_partkey", *(F.regexp_count("t", F.lit(tokens.TOKENS.get(k) or tokens.MORE[k])).cast("long").alias(k) for k in (*COUNTED, *MORE)))


# --- arrays -----------------------------------------------------------------------------------------------
@query("SELECT vec_id, CAST(least(vec_id % 2000, (vec_id % 5) * 480) AS INT) AS n FROM embeddings")
def trimmed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of padded batches cut to what their codes stand for."""
    made = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", made((F.col("vec_id") % 2000).cast("int")).alias("samples"), made((F.col("vec_id") % 5).cast("int")).alias("codes"))
    return rows.select("vec_id", F.size(signals.trim_output("samples", "codes")).alias("n"))


# --- files that are written and read again ----------------------------------------------------------------
@query("SELECT CAST(c_custkey AS VARCHAR) AS voice, concat('hello \"', c_name, '\"') AS input, c_custkey % 2 = 0 AS stream, CAST(c_custkey % 500 AS INT) AS max_tokens, round(c_custkey % 10 / 10.0, 1)::DOUBLE AS temperature FROM customer")
def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests, some lines of which are broken, as a table."""
    body = F.to_json(F.struct(F.concat(F.lit('hello "'), "c_name", F.lit('"')).alias("input"), text_of(F.col("c_custkey")).alias("voice"), (F.col("c_custkey") % 2 == 0).alias("stream"), (F.col("c_custkey") % 500).cast("int").alias("max_tokens"), F.round(F.col("c_custkey") % 10 / 10, 1).alias("temperature"), F.lit(1).alias("unknown")))
    lines = read(spark, sf_dir, "customer").select(F.explode(F.when(F.col("c_custkey") % 7 == 0, F.array(body, F.lit('{"input": '))).otherwise(F.array(body))).alias("value"))
    path = f"{writers.shared_folder(spark)}/bodies-{uuid.uuid4().hex}"
    lines.write.text(path)
    return readers.requests(spark, path).where("voice IS NOT NULL").select("voice", "input", "stream", "max_tokens", "temperature")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS longest FROM events GROUP BY event_type")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON, read again."""
    path = f"{writers.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    writers.json_report(read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("longest")), path)
    return readers.reports(spark, path, lines=True).select("event_type", "n", "longest")


@query("SELECT lower(r_name) AS word, CAST(count(*) AS VARCHAR) AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT DISTINCT c_mktsegment, NULL FROM customer")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map and a list as JSON files, read as one table of words."""
    path = f"{writers.shared_folder(spark)}/words-{uuid.uuid4().hex}"
    sizes = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.lower("r_name").alias("word")).agg(text_of(F.count("*")).alias("value"))
    sizes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "value")))).alias("value")).coalesce(1).write.text(f"{path}/map")
    segments = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    segments.agg(F.to_json(F.collect_list("c_mktsegment")).alias("value")).coalesce(1).write.text(f"{path}/list")
    return readers.dictionary(spark, f"{path}/map").unionByName(readers.dictionary(spark, f"{path}/list"))


# --- streams that end -------------------------------------------------------------------------------------
@query(
    "WITH s AS (SELECT o_custkey, list(o_orderkey % 65536 ORDER BY o_orderkey) AS codes FROM orders GROUP BY o_custkey), "
    f"n AS (SELECT o_custkey, codes, len(codes) AS n, greatest(len(codes) - {CONTEXT}, 0) // {CHUNK} AS whole FROM s), "
    f"k AS (SELECT *, unnest(range(0, whole + CASE WHEN whole * {CHUNK} < n THEN 1 ELSE 0 END)) AS k FROM n), "
    f"b AS (SELECT *, k * {CHUNK} AS a, CASE WHEN k < whole THEN (k + 1) * {CHUNK} ELSE n END AS b FROM k) "
    f"SELECT o_custkey, CAST(k AS INT) AS k, CAST(a AS INT) AS \"start\", CAST(b AS INT) AS \"end\", array_to_string(codes[greatest(a - {CONTEXT}, 0) + 1 : least(b + {CONTEXT}, n)], ' ') AS codes FROM b"
)
def flushed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as streams whose fragments are cut inside a code and whose ends have arrived: the rest is flushed."""
    schemas = {t: read(spark, sf_dir, t).schema for t in ("orders", "customer")}
    orders, ends = (spark.readStream.schema(s).parquet(f"{sf_dir}/{t}.parquet*") for t, s in schemas.items())
    half = lambda i, form: F.struct((F.col("o_orderkey") * 2 + i).alias("seq"), form.alias("fragment"))
    halves = F.array(half(0, F.lit("<|s")), half(1, F.concat(F.lit("_"), text_of(F.col("o_orderkey") % 65536), F.lit("|>"))))
    pieces = orders.select(text_of(F.col("o_custkey")).alias("request"), F.explode(halves).alias("p")).select("request", "p.seq", "p.fragment")
    last = ends.select(text_of(F.col("c_custkey")).alias("request"), F.lit((1 << 62) + 1).alias("seq"), F.lit(END).alias("fragment"))
    path = f"{writers.shared_folder(spark)}/flushed-{uuid.uuid4().hex}"
    chunks = chunk_stream(pieces.unionByName(last), CHUNK, CONTEXT)
    writers.stream_to(chunks, f"{path}/out", f"{path}/log").awaitTermination()
    found = spark.read.schema(chunks.schema).parquet(f"{path}/out")
    return found.select(F.col("request").cast(schemas["orders"]["o_custkey"].dataType).alias("o_custkey"), "k", "start", "end", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))
