"""More queries of the library: informal words, sounds, reports, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import arrays, dates, numbers, references, signals, text, words
from tessitura.operators import lexicon, metrics, reports, tokens, windows
from tessitura.plans import normalizer, queries
from tessitura.plans import reference_sql as S
from tessitura.plans.queries import CHUNK, CONTEXT, STREAMS, query, read, streams, text_of
from tessitura.sources import readers, writers
from tessitura.streaming.chunks import chunk_stream

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

SPELT = ["haha@x.com", "haha", "#hahaha", "HAHA", "aduh", "RM5"]


@query("SELECT c_custkey, ['haha@x.com','haha','#hahaha','HAHA','aduh','RM5'][CAST(c_custkey % 6 AS INT) + 1] AS w, c_custkey % 6 IN (0, 1, 2, 3, 5) AS laughs, c_custkey % 6 = 5 AS amount FROM customer")
def laughter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words laugh; tags and words in capitals pass."""
    w = F.get(numbers.words(SPELT), (F.col("c_custkey") % 6).cast("int"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", w.alias("w"))
    return rows.select("c_custkey", "w", words.sounds_like("w", words.LAUGHS).alias("laughs"), F.col("w").rlike(r"^RM\d").alias("amount"))


@query("SELECT c_custkey, concat(lower(c_mktsegment), ' haha ', CASE WHEN c_custkey % 2 = 0 THEN 'haha' ELSE 'ali@b.com' END) AS said FROM customer")
def replace_laughter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that laugh become laughter; ordinary words stay as they are."""
    source = F.concat(F.lower("c_mktsegment"), F.lit(" haha "), F.when(F.col("c_custkey") % 2 == 0, "kiki@b.com").otherwise("ali@b.com"))
    return read(spark, sf_dir, "customer").select("c_custkey", words.replace_any(source, words.LAUGHS, "haha").alias("said"))


@query(f"SELECT p_partkey, concat(p_brand, ' ') || {S.digits('CAST(p_partkey AS VARCHAR)', numbers.DIGITS_MS)} AS said FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS p_brand FROM part)")
def space_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters set apart from digits, which are read one by one."""
    source = F.concat(F.regexp_replace("p_brand", "[^A-Za-z]", ""), text_of(F.col("p_partkey")))
    return read(spark, sf_dir, "part").select("p_partkey", words.space_numbers(source).alias("said"))


@query(f"SELECT o_orderkey, ({S.cardinal_ms('CAST(o_custkey AS BIGINT)')}) || ' ' || ({S.cardinal_ms('CAST(o_orderkey AS BIGINT)')}) AS said FROM orders")
def all_cardinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers joined by a hyphen in words."""
    return read(spark, sf_dir, "orders").select("o_orderkey", words.all_cardinals(F.concat(text_of(F.col("o_custkey")), F.lit("-"), text_of(F.col("o_orderkey")))).alias("said"))


WITH_ENDING = [("bukulah", "buku", "lah"), ("makankn", "makan", "kan"), ("rumahnye", "rumah", "nya"), ("adalah", "adalah", ""), ("xyz", "xyz", ""), ("diala2", "dia2", "lah")]


@query("SELECT s_suppkey, e.* FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{w}', '{s}', '{e}')" for i, (w, s, e) in enumerate(WITH_ENDING)) + ") e(i, w, stem, ending) ON s_suppkey % 6 = e.i")
def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and standard endings of words."""
    i = (F.col("s_suppkey") % 6).cast("int")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", i.alias("i"), F.get(numbers.words([w for w, _, _ in WITH_ENDING]), i).alias("w"))
    return rows.withColumn("e", words.without_ending("w")).select("s_suppkey", "i", "w", F.col("e.stem").alias("stem"), F.col("e.ending").alias("ending"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Doktor' WHEN 1 THEN 'dr' ELSE 'Yang Berhormat' END AS title, CASE c_custkey % 3 WHEN 0 THEN 'tidak' WHEN 1 THEN 'dan' ELSE 'zz' END AS letter, CASE WHEN c_custkey % 3 = 0 THEN 'tak nak' ELSE 'apa' END AS word FROM customer")
def titles_and_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, single letters and negations."""
    k = F.col("c_custkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    return read(spark, sf_dir, "customer").select(
        "c_custkey", words.spoken_title(pick("Dr", "dr", "YB")).alias("title"), words.spoken_letter(pick("x", "n", "zz")).alias("letter"), words.negated(pick("xnak", "ape", "apa")).alias("word")
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_mfgr_w ELSE array_to_string(list_transform(range(0, CAST(p_partkey % 3 + 1 AS BIGINT)), lambda i: p_mfgr_w), '-') END AS said FROM (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS p_mfgr_w FROM part)")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a digit at the end said that often."""
    word, k = F.lower(F.get(F.split("p_name", " "), 0)), (F.col("p_partkey") % 3).cast("int")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, word).otherwise(F.concat(word, text_of(k + 1))).alias("w"))
    return rows.withColumn("r", text.check_repeat("w")).select("p_partkey", text.repeat_word(F.col("r.stem"), F.col("r.times")).alias("said"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'small', '1'), 'ring', '2'), 'large', '3') AS said FROM part")
def multireplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several words replaced in one pass."""
    return read(spark, sf_dir, "part").select("p_partkey", words.multireplace("p_name", {"small": "1", "ring": "2", "large": "3"}).alias("said"))


NUMERALS = "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(CAST(event_id AS STRING), '.5') WHEN 2 THEN concat('x', CAST(event_id AS STRING)) WHEN 3 THEN concat(CAST(event_id AS STRING), '.') ELSE concat('-', CAST(event_id AS STRING)) END"


@query(f"SELECT event_id, user_id, event_type, value, regexp_full_match({NUMERALS.replace('STRING', 'VARCHAR')}, '[0-9]+([.][0-9]+)?') AS kept FROM events")
def number_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of whole numbers, decimals, words, cut and negative numbers are numbers."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", words.is_number(F.expr(NUMERALS)).alias("kept"))


# --- entities -----------------------------------------------------------------------------------------
COUNTED = {"email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+", "hex40": r"\b[0-9A-Fa-f]{40}\b", "long_number": r"[0-9]{12,}"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in COUNTED.items()) + " FROM documents")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of detail occurs."""
    return read(spark, sf_dir, "documents").select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in COUNTED.items()))


@query(f"SELECT o_orderkey, 'pada ' || ({S.cardinal_ms('CAST(day(o_orderdate) AS BIGINT)')}) || ' hari bulan ' || ({S.cardinal_ms('CAST(month(o_orderdate) AS BIGINT)')}) AS said, ({S.cardinal_ms('CAST(o_orderkey % 30 + 1 AS BIGINT)')}) || ' hari bulan' AS hb, ({S.cardinal_ms('CAST(1400 + o_orderkey % 50 AS BIGINT)')}) || ' Hijrah' AS hijri FROM orders")
def malay_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of months, ``hb`` and Hijri years."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.day_month_words(text_of(F.dayofmonth("o_orderdate")), text_of(F.month("o_orderdate"))).alias("said"),
        dates.hari_bulan_words(F.concat(text_of(k % 30 + 1), F.lit("hb"))).alias("hb"),
        dates.hijri_words(F.concat(text_of(1400 + k % 50), F.lit("H"))).alias("hijri"),
    )


@query("SELECT p_partkey, 'HTTPS www dot shop dot com/' || ' ' || " + S.digits("CAST(p_partkey AS VARCHAR)", numbers.DIGITS_MS) + " AS said FROM part")
def url_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as they are spoken."""
    source = F.concat(F.lit("https://www.shop.com/"), text_of(F.col("p_partkey")))
    return read(spark, sf_dir, "part").select("p_partkey", normalizer.spoken_url(source).alias("said"))


# --- prompts, responses, sources ----------------------------------------------------------------------
@query("SELECT c_custkey, concat('<|im_start|>', c_name, '<|speech_start|>', '<|s_', c_custkey, '|><|s_', c_custkey + 1, '|>', '<|im_end|><|im_start|>', c_mktsegment, '<|speech_start|>') AS prompt FROM customer")
def prompt_vc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that continue a reference."""
    codes = F.array(F.col("c_custkey"), F.col("c_custkey") + 1)
    return read(spark, sf_dir, "customer").select("c_custkey", normalizer.vc_prompt(F.col("c_name"), codes, F.col("c_mktsegment")).alias("prompt"))


@query("SELECT c_custkey, '{\"output\":\"' || c_name || '\"}' AS body FROM customer")
def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON."""
    return read(spark, sf_dir, "customer").select("c_custkey", writers.response("c_name").alias("body")).select("c_custkey", "body")


@query("SELECT c_custkey, json_extract_string(body, '$.model') AS model, CAST(json_extract(body, '$.max_tokens') AS INT) AS max_tokens, json_extract_string(body, '$.prompt') AS prompt FROM (SELECT c_custkey, to_json({'model': 'm', 'prompt': c_name, 'max_tokens': 64}) AS body FROM customer)")
def backend_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for completion, read back."""
    body = normalizer.backend_request(F.col("c_name"), "m", max_tokens=64)
    rows = read(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return rows.select("c_custkey", F.get_json_object("body", "$.model").alias("model"), F.get_json_object("body", "$.max_tokens").cast("int").alias("max_tokens"), F.get_json_object("body", "$.prompt").alias("prompt"))


@query("SELECT s_suppkey, list_transform(string_split(' TM_Mandarin, TM_English ,x', ','), lambda s: trim(s))[CAST(s_suppkey % 3 AS INT) + 1] AS speaker FROM supplier")
def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of a list in a setting."""
    names = F.transform(F.split(F.lit(" TM_Mandarin, TM_English ,x"), ","), lambda n: F.trim(n))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 3).cast("int")).alias("speaker"))


@query("SELECT n_nationkey, CAST(r AS INT) AS round, concat('<|s_', n_nationkey, '|>') AS fragment FROM nation, range(1, 4) t(r)")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments replayed three times."""
    return readers.replay(read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("<|s_"), text_of(F.col("n_nationkey")), F.lit("|>")).alias("fragment")), 3)


@query("SELECT n_name AS value, max(n_nationkey) AS key FROM nation GROUP BY n_name")
def reverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map turned round; the greatest of several keys counts."""
    table = read(spark, sf_dir, "nation").select(F.lpad(text_of(F.col("n_nationkey")), 4, "0").alias("word"), F.col("n_name").alias("value"))
    return readers.inverted(table).select(F.col("word").alias("value"), F.col("value").cast(read(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("key"))


# --- sounds -------------------------------------------------------------------------------------------
@query("SELECT vec_id, CAST(44 + 2 * len(embedding) AS INT) AS bytes, len(embedding) / 24000.0::DOUBLE AS seconds, '52494646' || upper(to_hex_le) AS head FROM (SELECT vec_id, embedding, lower(concat(lpad(printf('%x', (36 + 2 * len(embedding)) % 256), 2, '0'), lpad(printf('%x', (36 + 2 * len(embedding)) // 256), 2, '0'), '0000')) AS to_hex_le FROM embeddings)")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files: their size, duration and first bytes."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", writers.encoded("embedding").alias("w"))
    return rows.select("vec_id", F.length("w").alias("bytes"), arrays.wav_seconds("w").alias("seconds"), F.hex(F.substring("w", 1, 8)).alias("head"))


@query("SELECT p_partkey, CAST(320 - p_partkey % 320 AS BIGINT) AS padding, CAST(p_size + greatest(64 - p_size, 0) AS INT) AS padded FROM part")
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that fill a frame, and codes padded to a bucket."""
    codes = F.array_repeat(F.lit(1), F.col("p_size").cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", arrays.frame_padding("p_partkey").cast("long").alias("padding"), F.size(arrays.pad_to(codes, F.lit(64))).alias("padded"))


@query("SELECT vec_id, CAST(least(len(embedding), 20) AS INT) AS n FROM embeddings")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays cut to the shorter of two."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size(signals.aligned("embedding", F.sequence(F.lit(1), F.lit(20)))["a"]).alias("n"))


@query(
    "WITH f AS (SELECT vec_id // 4 AS clip, vec_id % 4 AS k, embedding FROM embeddings), "
    "r AS (SELECT clip, k * 32 + i - 16 AS \"at\", CAST(embedding[i + 1] AS DOUBLE) AS x, 0.5 * (1 - cos(2 * pi() * i / 64)) AS w FROM f, range(0, 64) t(i)) "
    "SELECT clip, CAST(\"at\" AS BIGINT) AS \"at\", round(sum(x * w) / sum(w * w), 6) AS value FROM r JOIN (SELECT clip AS c, (max(k) + 1) * 32 AS n FROM f GROUP BY clip) ON clip = c AND \"at\" >= 0 AND \"at\" < n GROUP BY clip, r.\"at\" HAVING sum(w * w) > 1e-11"
)
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed frames of four vectors added up."""
    frames = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("clip"), (F.col("vec_id") % 4).alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return signals.overlap_add(frames, "clip", "k", "s", 32, 64).select("clip", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


# --- reports ------------------------------------------------------------------------------------------
@query("SELECT n_nationkey, CAST(k AS INT) AS k FROM nation, range(0, 3) t(k)")
def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items times samples."""
    return reports.samples_of(read(spark, sf_dir, "nation").select("n_nationkey"), 3)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS errors, string_agg(m, '|' ORDER BY event_id) FILTER (r <= 3) AS sample FROM (SELECT event_type, event_id, concat('HTTP ', user_id) AS m, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value > 50) GROUP BY event_type")
def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per level with the first three messages."""
    rows = read(spark, sf_dir, "events").withColumn("m", F.when(F.col("value") > 50, F.concat(F.lit("HTTP "), text_of(F.col("user_id")))))
    return reports.errors(rows, "event_type", "m", "event_id")


@query(
    f"WITH w AS (SELECT item_id, string_split({queries.NORM_SQL.format('text')}, ' ') AS w, {queries.NORM_SQL.format('text')} AS t FROM benchmark), "
    "h AS (SELECT item_id, w, t, array_to_string(list_transform(w, lambda x: CASE WHEN ends_with(x, 'th') THEN left(x, length(x) - 2) || 'qqz' ELSE x END), ' ') AS hyp FROM w) "
    "SELECT CASE WHEN item_id % 2 = 0 THEN 'ms' ELSE 'en' END AS \"group\", CAST(count(*) AS BIGINT) AS n, round(avg(levenshtein(t, hyp) / CAST(length(t) AS DOUBLE)), 4) AS cer, "
    "round(avg(CAST(len(list_filter(w, lambda x: ends_with(x, 'th'))) AS DOUBLE) / len(w)), 4) AS wer FROM h GROUP BY ALL"
)
def cer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in which some words are wrong, joined to their manifest, and their error rates by group."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.when(F.col("item_id") % 2 == 0, "ms_").otherwise("en_"), text_of(F.col("item_id"))).alias("id"), F.lit(0).alias("k"), "text")
    joined = reports.joined_transcripts(items, items.select("id", "k", F.regexp_replace(metrics.comparison_form("text"), r"th(?= |$)", "qqz").alias("hyp")))
    return reports.error_rates_by_group(joined)


@query("SELECT user_id, event_type, min(event_id) AS \"first\", CAST(count(*) AS BIGINT) AS length FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, run, event_type")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type per user."""
    return reports.runs(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT item_id, CAST(pos AS INT) AS pos, array_to_string(list_slice(ws, greatest(pos - 1, 1), pos + 3), ' ') AS context FROM (SELECT item_id, ws, unnest(range(0, len(ws))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark))")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with two on both sides."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "token"))
    return tokens.context_window(rows, "item_id", width=2).select("item_id", "pos", "context")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, printf('level=%s n=%d latency_avg=%.3f', event_type, count(*), avg(value)) AS line FROM events GROUP BY event_type")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report."""
    events = read(spark, sf_dir, "events").withColumn("audio", F.col("value") * 2)
    report = metrics.level_report(events, "event_type", "value", "audio", "value")
    lines = writers.report_lines(report, "event_type")
    return report.select("event_type", "n").join(lines.withColumn("event_type", F.regexp_extract("line", r"level=(\S+)", 1)), "event_type")


SOUND_SQL = "CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value * (event_id % 7 + 1) / 4 END"


def ranked_sql(values: str, q: float) -> str:
    """The element of a sorted list at int(q * n) - 1, the last where that is -1."""
    return f"{values}[CASE WHEN CAST(floor(len({values}) * {q}) AS INT) = 0 THEN len({values}) ELSE CAST(floor(len({values}) * {q}) AS INT) END]"


@query(
    f"WITH e AS (SELECT event_type, value, {SOUND_SQL} AS audio FROM events), r AS (SELECT *, CASE WHEN audio > 0 THEN value / audio END AS rtf FROM e), "
    "g AS (SELECT event_type, count(value) AS n, avg(audio) AS audio_avg, list_sort(list(value) FILTER (value IS NOT NULL)) AS t, avg(value) AS ta, list_sort(list(rtf) FILTER (rtf IS NOT NULL)) AS f, avg(rtf) AS fa FROM r GROUP BY event_type) "
    "SELECT event_type, CAST(n AS BIGINT) AS n, round(audio_avg, 6) AS audio_avg, "
    + ", ".join(
        f"round({v}[1], 6) AS {name}_min, round({v}[len({v})], 6) AS {name}_max, round({v}a, 6) AS {name}_avg, round(list_median({v}), 6) AS {name}_p50, " + ", ".join(f"round({ranked_sql(v, p / 100)}, 6) AS {name}_p{p}" for p in (90, 95, 99))
        for name, v in (("time", "t"), ("rtf", "f"))
    )
    + " FROM g"
)
def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a load test's report; a tenth of the requests have no sound."""
    events = read(spark, sf_dir, "events").withColumn("audio", F.expr(SOUND_SQL))
    report = metrics.slo_report(events, "event_type", "value", "audio")
    return report.select("event_type", "n", *(F.round(c, 6).alias(c) for c in report.columns[2:]))


# --- streams ------------------------------------------------------------------------------------------
@query(
    f"WITH s AS ({STREAMS}), n AS (SELECT o_custkey, codes, len(codes) AS n, greatest(len(codes) - {CONTEXT}, 0) // {CHUNK} AS w FROM s), "
    f"k AS (SELECT *, unnest(range(0, w)) AS k FROM n) "
    f"SELECT o_custkey, CAST(k AS INT) AS k, CAST(k * {CHUNK} AS INT) AS \"start\", CAST((k + 1) * {CHUNK} AS INT) AS \"end\", array_to_string(codes[greatest(k * {CHUNK} - {CONTEXT}, 0) + 1 : least((k + 1) * {CHUNK} + {CONTEXT}, n)], ' ') AS codes FROM k"
)
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunks emitted by a running stream over the orders; ends have not arrived, so nothing is flushed."""
    schema = read(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    fragments = orders.select(text_of(F.col("o_custkey")).alias("request"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("<|s_"), text_of(F.col("o_orderkey") % 65536), F.lit("|>")).alias("fragment"))
    path = f"{writers.shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks = chunk_stream(fragments, CHUNK, CONTEXT)
    writers.stream_to(chunks, f"{path}/out", f"{path}/log").awaitTermination()
    key = schema["o_custkey"].dataType
    return spark.read.schema(chunks.schema).parquet(f"{path}/out").select(F.col("request").cast(key).alias("o_custkey"), "k", "start", "end", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query(f"SELECT o_custkey, CAST(len(codes) AS INT) AS n, CAST((len(codes) + 2) // 3 AS INT) AS windows FROM ({STREAMS})")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three codes without context."""
    sized = streams(spark, sf_dir).select("o_custkey", F.size("codes").alias("n"))
    return windows.chunk_bounds(sized, "o_custkey", "n", 3, 0).groupBy("o_custkey").agg(F.max("end").cast("int").alias("n"), F.count("*").cast("int").alias("windows"))


# --- references and currency ----------------------------------------------------------------------------
@query("SELECT page_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&') AS t FROM pages)")
def unescaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with their character references read."""
    return read(spark, sf_dir, "pages").select("page_id", references.unescape_html("html").alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT p_partkey, {S.cardinal_ms('CAST(p_partkey * 37 AS BIGINT)')} || ' ringgit' AS said FROM part")
def currency_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as amounts in words."""
    return read(spark, sf_dir, "part").select("p_partkey", numbers.currency_words(F.col("p_partkey") * 37).alias("said"))


# --- small operators ----------------------------------------------------------------------------------
@query("SELECT w FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) UNION SELECT DISTINCT c_mktsegment FROM customer")
def word_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two lists, each once."""
    names = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return names.unionByName(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("w"))).distinct()


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(string_split(c_name, ''), lambda x: x <> '' AND contains('MCDXLIV', x)))), '') AS letters, regexp_full_match(c_name, '[MCDXLIV]+') AS roman FROM customer")
def roman_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of names that are Roman numerals, by intersection of sets."""
    letters = F.array_intersect(F.split("c_name", ""), F.split(F.lit("MCDXLIV"), ""))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.filter(letters, lambda x: x != "")), "").alias("letters"), F.col("c_name").rlike("^[MCDXLIV]+$").alias("roman"))


@query(f"SELECT o_custkey, array_to_string(codes[1:3], ' ') AS capped, CAST(len(codes) - len(codes[1:3]) AS INT) AS cut FROM ({STREAMS}) WHERE len(codes) > 0")
def token_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams cut to three codes; empty ones are dropped."""
    rows = streams(spark, sf_dir).where(F.size("codes") > 0).withColumn("c", F.slice("codes", 1, 3))
    return rows.select("o_custkey", F.array_join(F.transform("c", lambda x: x.cast("string")), " ").alias("capped"), (F.size("codes") - F.size("c")).alias("cut"))


@query("SELECT p_partkey, contains('!\"#$%&''()*+,./:;<=>?@[\\]^_`{|}~', t) AS mark, lower(t) IN ('ringgit', 'sen', 'hmm', 'hhmm', 'hmmm') AS ignored FROM (SELECT p_partkey, ['!', '-', '.', 'Sen', 'hmm', 'a'][CAST(p_partkey % 6 AS INT) + 1] AS t FROM part)")
def marks_and_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation and words that are passed over."""
    t = F.get(numbers.words(["!", "-", ".", "Sen", "hmm", "a"]), (F.col("p_partkey") % 6).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", words.is_punctuation("t").alias("mark"), words.is_ignored("t").alias("ignored"))


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best, round(exp(-list_max(v)), 6) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)")
def best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the largest score and its exponential."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    top = F.array_max("v")
    return rows.select("vec_id", (F.array_position("v", top) - 1).cast("int").alias("best"), F.round(F.exp(-top), 6).alias("score"))


@query("SELECT event_id, regexp_extract(t, '[0-9]{1,2}:[0-9]{2}') AS clock, regexp_extract(t, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AS day FROM (SELECT event_id, concat('mula ', strftime(ts, '%H:%M'), ' ', strftime(ts, '%Y-%m-%d'), ' tamat') AS t FROM events)")
def dates_beside_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with the date beside them."""
    said = F.concat(F.lit("mula "), F.date_format("ts", "HH:mm"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" tamat"))
    pair = dates.dates_beside_times(said)
    return read(spark, sf_dir, "events").select("event_id", F.get(pair, 0).alias("p")).select("event_id", F.col("p.clock").alias("clock"), F.col("p.day").alias("day"))


@query("SELECT o_orderkey, concat('{\"', o_orderkey, '\":\"', o_custkey, '\"}') AS turned FROM orders")
def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps built from pairs and turned round."""
    pairs = F.map_from_entries(F.array(F.struct(text_of(F.col("o_custkey")), text_of(F.col("o_orderkey")))))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", pairs.alias("m"))
    return rows.select("o_orderkey", F.to_json(F.map_from_arrays(F.map_values("m"), F.map_keys("m"))).alias("turned"))


@query(f"WITH s AS ({STREAMS}), k AS (SELECT o_custkey, codes, unnest(range({CHUNK}, len(codes) + 1, {CHUNK})) AS seen FROM s) SELECT o_custkey, CAST(seen AS INT) AS seen, array_to_string(codes[seen - {CHUNK} + 1 : seen], ' ') AS codes FROM k")
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last codes whenever a whole chunk of them has arrived."""
    rows = windows.trailing_windows(streams(spark, sf_dir), "o_custkey", "codes", CHUNK)
    return rows.select("o_custkey", "seen", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query("SELECT event_id, CAST(rank - 1 AS BIGINT) % 4 AS worker FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events)")
def job_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each level dealt to four workers in turn."""
    return reports.in_turn(read(spark, sf_dir, "events"), "event_type", 4, "event_id").select("event_id", "worker")


# --- word lists, labels, marks --------------------------------------------------------------------------
FOLD_FROM = "".join([*(chr(k) for k, v in text.FOLDED.items() if v), *(chr(k) for k, v in text.FOLDED.items() if not v)])
FOLD_TO = "".join(v for v in text.FOLDED.values() if v)
FOLD_SQL = "translate(text, {}, {})".format(*("'" + x.replace("'", "''") + "'" for x in (FOLD_FROM, FOLD_TO)))


@query(f"SELECT doc_id, {FOLD_SQL} AS folded FROM documents")
def punctuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes, quotes and blanks of all kinds as plain ones."""
    return read(spark, sf_dir, "documents").select("doc_id", text.fold_punctuation("text").alias("folded"))


DATE_SLANG = [("2 bln lps", "2 bulan lalu"), ("3 hri dpn", "3 hari depan"), ("skrg", "sekarang"), ("esk pgi", "esok AM"), ("thun lepas", "tahun lalu")]


@query("SELECT o_orderkey, [{}][CAST(o_orderkey % 5 AS INT) + 1] AS plain FROM orders".format(", ".join(f"'{b}'" for _, b in DATE_SLANG)))
def date_slang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slang of dates in standard words."""
    t = F.get(numbers.words([a for a, _ in DATE_SLANG]), (F.col("o_orderkey") % 5).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.plain_date_words(t).alias("plain"))


@query("SELECT w, lower(w) = 'the' OR w IN ('and', 'The') AS malay FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)")
def malay_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are slang but not English, or in a word list."""
    words_ = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    table = lambda *entries: spark.createDataFrame([(e,) for e in entries], "word string")
    return lexicon.malay(words_, table("the", "of", "hers"), table("of", "her"), table("and", "The"), "w").select("w", "malay")


@query("SELECT n_nationkey, n_name, n_name IN ('FRANCE', 'UNITED STATES', 'PERU') AS place FROM nation")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are states in lower case, or other places with capitals."""
    table = spark.createDataFrame([("France", "state"), ("United States", "country"), ("Peru", "city"), ("peRu", "city"), ("CHINA", "country")], "word string, kind string")
    return lexicon.places(read(spark, sf_dir, "nation"), table, "n_name").select("n_nationkey", "n_name", "place")


@query("SELECT vec_id, CAST('label' || (list_position(embedding, list_max(embedding)) - 1) AS VARCHAR) AS label FROM embeddings")
def top_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with the largest score of each vector."""
    labels = F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("label"), text_of(i)).alias("label"), x.alias("score")))
    return read(spark, sf_dir, "embeddings").select("vec_id", lexicon.best_label(labels).alias("label"))


@query("SELECT conv_id, turn, r.role AS answer FROM conversations q LEFT JOIN (SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant') r USING (conv_id, turn)")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the answer that belongs to them, if any."""
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("request"), "role")
    joined = reports.answered(turns.select("request"), turns.where("role = 'assistant'").select("request", F.col("role").alias("answer")))
    return joined.select("request.conv_id", "request.turn", "answer")
