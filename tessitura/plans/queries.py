"""The queries of the library over the data tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import arrays, chinese, dates, numbers, text
from tessitura.operators import lexicon, metrics, ranks, tokens, windows
from tessitura.plans import normalizer
from tessitura.plans import reference_sql as S
from tessitura.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it has one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores: a small file is one task, whatever each of its rows costs."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def text_of(c: Column) -> Column:
    return c.cast("string")


# --- mark-up, white space, characters -----------------------------------------------------------------
MARKED = "concat('# ', p_name, '\n**', p_name, '** and `', p_type, '` [', p_brand, '](http://x.y/', p_partkey, ') ~~', p_size, '~~ <b>', p_name, '</b>')"
MARK_RULES = [
    (r"`([^`]*)`", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"~~(.+?)~~", r"\1"), (r"<[^>]+>", ""),
]
PLAIN_RULES = [
    (r"```[\s\S]*?```", ""), (r"`([^`]*)`", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
    (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"\*\*\*(.+?)\*\*\*", r"\1"), (r"___(.+?)___", r"\1"), (r"\*\*(.+?)\*\*", r"\1"),
    (r"__(.+?)__", r"\1"), (r"\*(.+?)\*", r"\1"), (r"~~(.+?)~~", r"\1"), (r"(?m)^>\s+", ""), (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"<[^>]+>", ""),
]
BEFORE_SQL = "translate({}, '–;’!！', ' ,''，，')"


@query(f"SELECT p_partkey, {S.replaced(MARKED, MARK_RULES)} AS clean FROM part")
def md_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark-up around part names is removed."""
    part = read(spark, sf_dir, "part")
    marked = F.expr(MARKED.replace("\n", "\\n"))
    return part.select("p_partkey", text.sanitize_markdown(marked).alias("clean"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags are removed from pages."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]+>", "").alias("bare"))


PLAIN_SQL = "trim(regexp_replace(regexp_replace({}, '\n', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    "WITH a AS (SELECT conv_id, turn, replace(replace(replace(replace(replace("
    + PLAIN_SQL.format(S.replaced("text", PLAIN_RULES))
    + ", '–', ' '), ';', ','), '’', ''''), '!', ','), '！', '，') AS t FROM conversations), "
    "b AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(replace(t, '–', ' '), ';', ','), '-', ' '), '(', ''), ')', ''), '[', ''), ']', ''), '’', '''') AS t FROM a) "
    "SELECT conv_id, turn, " + PLAIN_SQL.format("CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END") + " AS plain FROM b"
)
def normalize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline without language over all conversation turns."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_plain("text").alias("plain"))


@query()
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all documents, whose underscores and white space SQL has no look-around for."""
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_plain("text").alias("plain"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '–', ' '), ';', ','), '’', ''''), '!', ','), '！', '，') AS mapped FROM documents")
def char_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that are mapped before normalisation."""
    return read(spark, sf_dir, "documents").select("doc_id", text.before_map("text").alias("mapped"))


SAYINGS = ["I can't go", "DON'T stop", "She's here", "they'll come", "We're in, aren't we", "it's what you've won't"]
SAID = ["I cannot go", "Do not stop", "She is here", "they will come", "We are in, are not we", "it is what you have will not"]


@query(f"SELECT c_custkey, concat(c_name, ' ', {S.words([s.replace(chr(39), chr(39) * 2) for s in SAID])}[CAST(c_custkey % {len(SAID)} AS INT) + 1]) AS expanded FROM customer")
def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English contractions after customer names."""
    said = F.concat("c_name", F.lit(" "), F.get(numbers.words(SAYINGS), (F.col("c_custkey") % len(SAYINGS)).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", text.expand_contractions(said).alias("expanded"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(concat(p_brand, p_partkey, 'kg'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS parted FROM part")
def alpha_num_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits that touch are set apart."""
    return read(spark, sf_dir, "part").select("p_partkey", text.split_alpha_num(F.concat("p_brand", text_of(F.col("p_partkey")), F.lit("kg"))).alias("parted"))


@query("SELECT c_custkey, concat('doctor ', c_custkey, ' E M G S M R T K L five G ', c_mktsegment) AS said FROM customer")
def pronounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations as they are spoken."""
    source = F.concat(F.lit("dr "), text_of(F.col("c_custkey")), F.lit(" emgs MRT KL 5G "), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.pronounce(source).alias("said"))


@query(f"SELECT l_orderkey, l_linenumber, {S.cardinal_ms('CAST(l_linenumber AS BIGINT)')} || ' hingga ' || {S.cardinal_ms('CAST(l_quantity AS BIGINT)')} || ' kg' AS said FROM lineitem")
def range_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges with a unit in Malay."""
    source = F.concat(text_of(F.col("l_linenumber")), F.lit("-"), text_of(F.col("l_quantity").cast("long")), F.lit(" kg"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.range_words(source).alias("said"))


# --- numbers ------------------------------------------------------------------------------------------
@query(f"SELECT o_orderkey, {S.cardinal_ms('CAST(o_orderkey*7919 AS BIGINT)')} AS said FROM orders")
def cardinal_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malay cardinals."""
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.cardinal_ms(text_of(F.col("o_orderkey") * 7919)).alias("said"))


@query(f"SELECT l_orderkey, l_linenumber, {S.cardinal_en('CAST(l_partkey*1009 AS BIGINT)')} AS said FROM lineitem")
def cardinal_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English cardinals."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.cardinal_en(text_of(F.col("l_partkey") * 1009)).alias("said"))


@query(f"SELECT o_orderkey, {S.cardinal_zh('CAST(o_orderkey*613 % 100000000 AS BIGINT)')} AS said FROM orders")
def cardinal_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese cardinals."""
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.cardinal_zh(text_of(F.col("o_orderkey") * 613 % 100_000_000)).alias("said"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'pertama' ELSE 'ke' || ({S.cardinal_ms('CAST(c_custkey AS BIGINT)')}) END AS said FROM customer")
def ordinal_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malay ordinals."""
    return read(spark, sf_dir, "customer").select("c_custkey", numbers.ordinal_ms(text_of(F.col("c_custkey"))).alias("said"))


LAST = "regexp_extract(c, '[a-z]+$')"


@query(
    f"WITH a AS (SELECT p_partkey, {S.cardinal_en('CAST(p_partkey AS BIGINT)', '-')} AS c FROM part) SELECT p_partkey, regexp_replace(c, '[a-z]+$', '') || "
    f"CASE {LAST} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in numbers.ORDINALS_EN.items()) + f" ELSE CASE WHEN ends_with({LAST}, 'y') THEN regexp_replace({LAST}, 'y$', 'ieth') ELSE {LAST} || 'th' END END AS said FROM a"
)
def ordinal_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English ordinals with hyphens."""
    return read(spark, sf_dir, "part").select("p_partkey", numbers.ordinal_en(text_of(F.col("p_partkey"))).alias("said"))


@query(f"SELECT s_suppkey, {S.digits('CAST(s_suppkey*97 AS VARCHAR)', numbers.DIGITS_MS)} AS said FROM supplier")
def digits_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers digit by digit."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", numbers.digit_words(text_of(F.col("s_suppkey") * 97)).alias("said"))


ROMAN_TENS, ROMAN_ONES = ["", "X", "XX", "XXX", "XL", "L"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part")
def roman_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals of sizes read back."""
    n = F.col("p_size").cast("int")
    roman = F.concat(F.get(numbers.words(ROMAN_TENS), (n / 10).cast("int")), F.get(numbers.words(ROMAN_ONES), n % 10))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.roman_to_int(roman).alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, {S.cardinal_ms('CAST(l_linenumber AS BIGINT)')} || ' per ' || {S.cardinal_ms('CAST(l_quantity AS BIGINT)')} AS said FROM lineitem")
def fraction_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions in Malay."""
    source = F.concat(text_of(F.col("l_linenumber")), F.lit("/"), text_of(F.col("l_quantity").cast("long")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.fraction(source).alias("said"))


CENTS = "CAST(round(o_totalprice*100) AS BIGINT)"


def amount_sql(unit: str, cent: str, say: Callable[[str], str], zero: str) -> str:
    whole, part = f"{CENTS}//100", f"{CENTS}%100"
    return f"concat_ws(' ', CASE WHEN {whole}>0 THEN ({say(whole)})||' {unit}' END, ({say(part)})||' {cent}')"


def price(sign: str) -> Column:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return F.concat(F.lit(sign), text_of(F.floor(cents / 100)), F.lit("."), F.lpad(text_of(cents % 100), 2, "0"))


@query(f"SELECT o_orderkey, {amount_sql('ringgit', 'sen', S.cardinal_ms, 'kosong')} AS said, concat('RM', {CENTS}//100, '.', lpad(CAST({CENTS}%100 AS VARCHAR), 2, '0')) AS canonical FROM orders")
def money_rm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in ringgit and sen."""
    m = read(spark, sf_dir, "orders").select("o_orderkey", numbers.money(price("RM")).alias("m"))
    return m.select("o_orderkey", F.col("m.spoken").alias("said"), F.col("m.canonical").alias("canonical"))


@query(f"SELECT o_orderkey, {amount_sql('dollar', 'cent', S.cardinal_en, 'zero')} AS said FROM orders")
def money_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in dollars and cents."""
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.money(price("$"), english=True)["spoken"].alias("said"))


@query(f"SELECT l_orderkey, l_linenumber, {S.cardinal_ms('CAST(round(l_discount*100) AS BIGINT)')} || ' peratus' AS said FROM lineitem")
def percent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts in per cent."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.percent(F.concat(text_of(F.round(F.col("l_discount") * 100).cast("long")), F.lit("%"))).alias("said"))


UNIT_LIST = [("kg", "kilogram"), ("km", "kilometer"), ("ml", "milliliter"), ("MB", "megabait"), ("gb", "gigabit")]


@query(f"SELECT p_partkey, {S.cardinal_ms('CAST(p_size AS BIGINT)')} || ' ' || {S.words([u for _, u in UNIT_LIST])}[CAST(p_partkey % {len(UNIT_LIST)} AS INT) + 1] AS said FROM part")
def units_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with units."""
    source = F.concat(text_of(F.col("p_size")), F.get(numbers.words([u for u, _ in UNIT_LIST]), (F.col("p_partkey") % len(UNIT_LIST)).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.unit_words(source).alias("said"))


@query(f"SELECT l_orderkey, l_linenumber, {S.cardinal_en('CAST(l_quantity AS BIGINT)')} || ' times' AS said FROM lineitem")
def times_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as multiples."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.times(F.concat(text_of(F.col("l_quantity").cast("long")), F.lit("x")), english=True).alias("said"))


@query("SELECT p_partkey, CAST(p_partkey*1500 AS VARCHAR) AS n FROM part")
def shortform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a short suffix written out."""
    tenth = F.concat(text_of(F.floor(F.col("p_partkey") * 15 / 10)), F.lit("."), text_of(F.col("p_partkey") * 15 % 10), F.lit("k"))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.shortform(tenth).alias("n"))


@query("SELECT o_orderkey, CAST(o_orderkey*31 AS BIGINT) AS n FROM orders")
def words_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malay cardinals read back as numbers."""
    said = read(spark, sf_dir, "orders").select("o_orderkey", numbers.cardinal_ms(text_of(F.col("o_orderkey") * 31)).alias("said"))
    return said.select("o_orderkey", numbers.words_to_number("said").alias("n"))


# --- dates and times ----------------------------------------------------------------------------------
MONTH = "{}[CAST(month(o_orderdate) AS INT)]"


@query(f"SELECT o_orderkey, {S.cardinal_ms('CAST(day(o_orderdate) AS BIGINT)')} || ' ' || {MONTH.format(S.words(dates.MONTHS_MS))} || ' ' || {S.cardinal_ms('CAST(year(o_orderdate) AS BIGINT)')} AS said FROM orders")
def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in Malay, written month first."""
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_words(F.date_format("o_orderdate", "M/d/yyyy")).alias("said"))


HOUR, MINUTE = "CAST(hour(ts) AS BIGINT)", "CAST(minute(ts) AS BIGINT)"


@query(
    f"SELECT event_id, 'pukul ' || {S.cardinal_ms(f'CASE WHEN {HOUR}%12=0 THEN 12 ELSE {HOUR}%12 END')} || CASE WHEN {MINUTE}>0 THEN ' ' || ({S.cardinal_ms(MINUTE)}) || ' minit' ELSE '' END"
    f" || CASE WHEN {HOUR}<12 THEN ' pagi' WHEN {HOUR}<19 THEN ' petang' ELSE ' malam' END AS said FROM events"
)
def time_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in Malay."""
    return read(spark, sf_dir, "events").select("event_id", dates.time_words(F.date_format("ts", "HH:mm")).alias("said"))


YEAR = "CAST(year(l_shipdate) AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {YEAR}=2000 OR ({YEAR}<2000 AND {YEAR}//100%10=0) THEN {S.cardinal_ms(YEAR)} ELSE ({S.cardinal_ms(f'{YEAR}//100')}) || ' ' || ({S.cardinal_ms(f'{YEAR}%100')}) END AS said FROM lineitem")
def year_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of shipping in pairs."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.year_words(text_of(F.year("l_shipdate"))).alias("said"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 + 1 AS INT) AS day FROM orders")
def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days ago, from an explicit day."""
    said = F.concat(text_of(F.col("o_orderkey") % 9 + 1), F.lit(" hari lalu"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.relative_date(said, "o_orderdate").alias("day"))


# --- Chinese ------------------------------------------------------------------------------------------
@query(f"SELECT p_partkey, '比例百分之' || ({S.cardinal_zh('CAST(p_size AS BIGINT)')}) || '，重' || ({S.cardinal_zh('CAST(p_partkey AS BIGINT)')}) || '公斤，共' || ({S.cardinal_zh('CAST(p_partkey*7 AS BIGINT)')}) || '件' AS said FROM part")
def zh_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent, weight and number inside Chinese text."""
    source = F.concat(F.lit("比例"), text_of(F.col("p_size")), F.lit("%，重"), text_of(F.col("p_partkey")), F.lit("kg，共"), text_of(F.col("p_partkey") * 7), F.lit("件"))
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return chinese.normalize_chinese(part.select("p_partkey", source.alias("said")), "said")


@query(f"SELECT o_orderkey, ({S.cardinal_zh(f'{CENTS}//100')}) || '令吉' || CASE WHEN {CENTS}%100>0 THEN ({S.cardinal_zh(f'{CENTS}%100')}) || '仙' ELSE '' END AS said FROM orders")
def zh_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in Chinese."""
    return read(spark, sf_dir, "orders").select("o_orderkey", chinese.money_zh(price("RM")).alias("said"))


@query(f"SELECT o_orderkey, ({S.digits('CAST(year(o_orderdate) AS VARCHAR)', numbers.DIGITS_ZH, '')}) || '年' || ({S.cardinal_zh('CAST(month(o_orderdate) AS BIGINT)')}) || '月' || ({S.cardinal_zh('CAST(day(o_orderdate) AS BIGINT)')}) || '日' AS said FROM orders")
def zh_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in Chinese."""
    return read(spark, sf_dir, "orders").select("o_orderkey", chinese.date_zh(F.date_format("o_orderdate", "d-M-yyyy")).alias("said"))


@query(f"SELECT event_id, CASE WHEN {HOUR}<12 THEN '上午' ELSE '下午' END || ({S.cardinal_zh(f'CASE WHEN {HOUR}%12=0 THEN 12 ELSE {HOUR}%12 END')}) || '点' || CASE WHEN {MINUTE}>0 THEN ({S.cardinal_zh(MINUTE)}) || '分' ELSE '' END AS said FROM events")
def zh_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in Chinese."""
    return read(spark, sf_dir, "events").select("event_id", chinese.time_zh(F.date_format("ts", "HH:mm")).alias("said"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) > length(regexp_replace(text, '[\\x00-\\x7F一-鿿㐀-䶿\\s]', '', 'g')) AS BOOLEAN) AS dominant FROM (SELECT doc_id, concat(text, repeat('语', CAST(doc_id % 9 AS INT))) AS text FROM documents)")
def chinese_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether Chinese outweighs other scripts beyond ASCII."""
    mixed = F.concat("text", F.repeat(F.lit("语"), (F.col("doc_id") % 9).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", chinese.chinese_dominant(mixed).alias("dominant"))


# --- identifiers, addresses ---------------------------------------------------------------------------
@query(f"SELECT c_custkey, {S.digits('lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, chr(48))', numbers.DIGITS_MS)} || ', ' || {S.digits('lpad(CAST(c_custkey AS VARCHAR), 7, chr(48))', numbers.DIGITS_MS)} AS said FROM customer")
def phone_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers digit by digit."""
    phone = F.concat(F.lpad(text_of(F.col("c_custkey") % 1000), 3, "0"), F.lit("-"), F.lpad(text_of(F.col("c_custkey")), 7, "0"))
    return read(spark, sf_dir, "customer").select("c_custkey", normalizer.spoken_groups(phone, between=", ").alias("said"))


@query(f"SELECT c_custkey, 'CUSTOMER dot ' || {S.digits("split_part(c_name, '#', 2)", numbers.DIGITS_MS)} || ' di MAIL dot EXAMPLE dot COM' AS said FROM customer")
def email_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses as they are spoken."""
    address = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@mail.example.com"))
    return read(spark, sf_dir, "customer").select("c_custkey", normalizer.spoken_email(address).alias("said"))


# --- tokens, joins, windows ---------------------------------------------------------------------------
WORDS = r"[^\W\d_]+"


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT w) AS BIGINT) AS n_distinct, max(length(w)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY doc_id")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ASCII letters per document."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    told = found.where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.array_distinct("w").alias("w"))
    rows = told.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.flatten(F.collect_list("w")).alias("w"))  # rows of one document meet with their different words only
    return rows.select("doc_id", "n_tokens", F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_max(F.transform("w", lambda w: F.length(w).cast("long"))).alias("longest"))


@query()
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by kind, with the whole alternation."""
    counts = tokens.token_counts(spread(read(spark, sf_dir, "documents").select("text")), "text")
    return counts.withColumn("kind", tokens.token_kind("token")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


VOCABULARY = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)"
DOC_WORDS = "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents"


def doc_words(spark: SparkSession, sf_dir: str, table: str = "documents", *keys: str) -> DataFrame:
    return read(spark, sf_dir, table).select(*keys, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM ({DOC_WORDS}) WHERE w IN ({VOCABULARY}) GROUP BY doc_id")
def lexicon_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per document that a lexicon has."""
    return lexicon.members(doc_words(spark, sf_dir, "documents", "doc_id"), doc_words(spark, sf_dir, "benchmark"), "w").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM ({DOC_WORDS}) WHERE w NOT IN ({VOCABULARY}) GROUP BY doc_id")
def lexicon_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per document that a lexicon lacks."""
    return lexicon.strangers(doc_words(spark, sf_dir, "documents", "doc_id"), doc_words(spark, sf_dir, "benchmark"), "w").groupBy("doc_id").agg(F.count("*").alias("n"))


SUFFIXES = [("ing", "ing"), ("tion", "tion"), ("ed", "edd"), ("on", "on"), ("er", "er"), ("ly", "ly")]
SUFFIX_TABLE = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SUFFIXES) + ") s(suffix, value)"


@query(f"SELECT w, suffix FROM (SELECT w, suffix, row_number() OVER (PARTITION BY w ORDER BY length(value) DESC NULLS LAST, suffix DESC) AS r FROM ({VOCABULARY}) LEFT JOIN {SUFFIX_TABLE} ON ends_with(w, suffix)) WHERE r = 1")
def suffix_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest suffix of each word of the benchmark."""
    words = doc_words(spark, sf_dir, "benchmark").distinct()
    return lexicon.longest_suffix(words, spark.createDataFrame(SUFFIXES, "suffix string, value string"), "w").select("w", "suffix")


@query(f"SELECT w FROM ({VOCABULARY}) a WHERE NOT EXISTS (SELECT 1 FROM ({VOCABULARY}) b WHERE a.w <> b.w AND contains(b.w, a.w))")
def cluster_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that are part of no longer one."""
    return lexicon.keep_longest(doc_words(spark, sf_dir, "benchmark"), "w")


@query(
    "WITH t AS (SELECT item_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS token FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark)) "
    "SELECT item_id, CAST(pos AS INT) AS pos, token, lead(token, 1) OVER w AS next1, lead(token, 2) OVER w AS next2, lead(token, 3) OVER w AS next3 FROM t WINDOW w AS (PARTITION BY item_id ORDER BY pos)"
)
def lookahead_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the three that follow."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "token"))
    return tokens.with_lookahead(rows, "item_id")


@query("SELECT p_partkey, concat(left(p_name, length(p_name) - 1), repeat(right(p_name, 1), CAST(least(p_partkey % 5 + 1, 2) AS INT))) AS squashed FROM part WHERE NOT regexp_matches(p_name, concat('[', right(p_name, 1), ']', right(p_name, 1), '$'))")
def elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a drawn-out last letter cut to two of them."""
    part = read(spark, sf_dir, "part").where(F.right("p_name", F.lit(1)) != F.substring("p_name", F.length("p_name") - 1, F.lit(1)))
    drawn = F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.expr("repeat(right(p_name, 1), cast(p_partkey % 5 + 1 as int))"))
    return part.select("p_partkey", text.squash_runs(drawn).alias("squashed"))


@query(
    f"SELECT o_orderkey, concat('{{\"', strftime(o_orderdate, '%-d-%-m-%Y'), '\":\"', CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END, '\"}}') AS dates, "
    f"concat('{{\"RM', {CENTS}//100, '.', lpad(CAST({CENTS}%100 AS VARCHAR), 2, '0'), ' \":\"RM', {CENTS}//100, '.', lpad(CAST({CENTS}%100 AS VARCHAR), 2, '0'), '\",\"50 sen\":\"RM0.5\"}}') AS money FROM orders"
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and amounts found in composed sentences, as JSON."""
    said = F.concat(F.lit("bayar "), price("RM"), F.lit(" pada "), F.date_format("o_orderdate", "d-M-yyyy"), F.lit(" dan 50 sen"))
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
    found = orders.select("o_orderkey", said.alias("t")).select("o_orderkey", normalizer.entities("t").alias("e"))
    return found.select("o_orderkey", F.to_json("e.dates").alias("dates"), F.to_json("e.money").alias("money"))


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all conversation turns."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens.sentences("text")).alias("pos", "sentence"))


@query("SELECT c_custkey, len(list_filter(regexp_extract_all(concat(c_name, ' 语言 ', c_mktsegment, ' été ', c_custkey), '\\S+'), lambda s: regexp_matches(s, '[^\\x00-\\x7F]'))) AS n_foreign FROM customer")
def script_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of mixed text that are not ASCII."""
    mixed = F.concat("c_name", F.lit(" 语言 "), "c_mktsegment", F.lit(" été "), text_of(F.col("c_custkey")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.explode(tokens.segments(mixed)).alias("s"))
    return rows.groupBy("c_custkey").agg(F.count_if(chinese.script_of("s").isin("cjk", "other", "kana")).alias("n_foreign"))


# --- prompts, events, codes, chunks -------------------------------------------------------------------
@query("SELECT c_custkey, concat('<|im_start|>', c_mktsegment, ': ', c_name, '<|speech_start|>') AS prompt FROM customer")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for synthesis."""
    return read(spark, sf_dir, "customer").select("c_custkey", normalizer.tts_prompt(F.col("c_mktsegment"), F.col("c_name")).alias("prompt"))


@query("SELECT o_orderkey, concat('<|s_', o_orderkey % 65536, '|>') AS fragment FROM orders WHERE o_orderkey % 4 <> 0")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of event-stream lines; end marks and broken lines give none."""
    k = F.col("o_orderkey")
    whole = F.concat(F.lit('data: {"choices":[{"text":"<|s_'), text_of(k % 65536), F.lit('|>"}]}'))
    line = F.when(k % 4 != 0, whole).when(k % 8 == 0, "data: [DONE]").otherwise('data: {"choices":[')
    return readers.event_fragments(read(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))).select("o_orderkey", "fragment")


STREAMS = "SELECT o_custkey, list(CAST(o_orderkey % 65536 AS INT) ORDER BY o_orderkey) AS codes FROM orders GROUP BY o_custkey"
CHUNK, CONTEXT = 4, 2


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey"))).alias("o"))
    return rows.select("o_custkey", F.transform("o", lambda x: (x["o_orderkey"] % 65536).cast("int")).alias("codes"))


@query(f"SELECT o_custkey, CAST(len(codes) AS INT) AS n, CAST(list_sum(codes) AS BIGINT) AS total FROM ({STREAMS})")
def speech_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes read back from the text of a stream."""
    shown = streams(spark, sf_dir).select("o_custkey", F.array_join(F.transform("codes", lambda c: F.concat(F.lit("<|s_"), c.cast("string"), F.lit("|>"))), "").alias("t"))
    ids = shown.select("o_custkey", tokens.speech_codes("t").alias("ids"))
    return ids.select("o_custkey", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    f"WITH s AS ({STREAMS}), n AS (SELECT o_custkey, codes, len(codes) AS n, greatest(len(codes) - {CONTEXT}, 0) // {CHUNK} AS w FROM s), "
    f"k AS (SELECT *, unnest(range(0, w + CASE WHEN w * {CHUNK} < n THEN 1 ELSE 0 END)) AS k FROM n), "
    f"b AS (SELECT o_custkey, codes, k, k * {CHUNK} AS s, CASE WHEN k < w THEN (k + 1) * {CHUNK} ELSE n END AS e, n FROM k) "
    f"SELECT o_custkey, CAST(k AS INT) AS k, CAST(s AS INT) AS \"start\", CAST(e AS INT) AS \"end\", array_to_string(codes[greatest(s - {CONTEXT}, 0) + 1 : least(e + {CONTEXT}, n)], ' ') AS codes FROM b"
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of code streams with context."""
    out = windows.chunk_codes(streams(spark, sf_dir), "o_custkey", "codes", CHUNK, CONTEXT)
    return out.select("o_custkey", "k", "start", "end", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


BUCKETS = [64, 256, 1024, 4096]


@query("SELECT doc_id, CAST(coalesce(list_min(list_filter([64, 256, 1024, 4096], lambda b: b >= n_chars)), n_chars) AS BIGINT) AS bucket FROM documents")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest bucket for each length."""
    return read(spark, sf_dir, "documents").select("doc_id", arrays.bucket(F.col("n_chars"), BUCKETS).cast("long").alias("bucket"))


@query("SELECT event_id, epoch_ms(ts) // 60000 AS slot, CAST((row_number() OVER (PARTITION BY epoch_ms(ts) // 60000 ORDER BY ts, event_id) - 1) // 4 AS BIGINT) AS batch FROM events")
def microbatch_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in batches by arrival and size."""
    return windows.micro_batches(read(spark, sf_dir, "events"), "ts", 60_000, 4, "event_id").select("event_id", "slot", "batch")


# --- samples ------------------------------------------------------------------------------------------
@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(trunc(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 32767) AS INT)), ' ') AS samples FROM embeddings")
def pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 16-bit samples."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(arrays.pcm16("embedding"), lambda x: x.cast("string")), " ").alias("samples"))


@query("SELECT vec_id, CAST(len(list_filter(range(2, len(embedding) + 1), lambda i: (embedding[i] < 0) <> (embedding[i - 1] < 0))) AS INT) AS crossings FROM embeddings")
def zero_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of sign per vector."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size(arrays.zero_crossings("embedding")).alias("crossings"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)), 6) AS level FROM embeddings")
def rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squares, to six decimals."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.rms("embedding"), 6).alias("level"))


@query(
    "SELECT vec_id, round(list_sum(list_transform(range(0, 32), lambda i: CAST(embedding[i + 1] AS DOUBLE) * (1 - 0.5 * (1 - cos(pi() * i / 31))) + CAST(embedding[i + 33] AS DOUBLE) * 0.5 * (1 - cos(pi() * i / 31)))), 6) AS total FROM embeddings"
)
def crossfade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a vector's 64 samples faded into the second, summed."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    faded = arrays.crossfade(F.slice(d, 1, 32), F.slice(d, 33, 32))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(faded, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 8), lambda i: (p_partkey >> CAST(2 * i AS INT)) & 3), '') AS digits FROM part")
def code_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-4 digits of codes."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(arrays.code_digits(F.col("p_partkey").cast("int")), lambda d: d.cast("string")), "").alias("digits"))


# --- metrics ------------------------------------------------------------------------------------------
RANK = "CAST(CASE WHEN {r} - floor({r}) = 0.5 THEN 2 * round({r} / 2) ELSE round({r}) END AS INT)"


@query(
    "WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type) SELECT event_type, "
    + ", ".join(f"v[greatest(1, least(len(v), {RANK.format(r=f'(len(v) * {p / 100} + 0.5)')}))] AS p{p}" for p in (50, 95, 99))
    + " FROM s"
)
def pct_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by rounded rank."""
    return ranks.at_ranks(read(spark, sf_dir, "events"), ["event_type"], "value", {f"p{p}": metrics.bench_rank(p) for p in (50, 95, 99)})


@query("WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type) SELECT event_type, v[CASE WHEN CAST(floor(len(v) * 0.95) AS INT) = 0 THEN -1 ELSE CAST(floor(len(v) * 0.95) AS INT) END] AS p95 FROM s")
def pct_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by cut rank."""
    return ranks.at_ranks(read(spark, sf_dir, "events"), ["event_type"], "value", {"p95": metrics.stress_rank(0.95)})


def bench_sql(values: str, p: int) -> str:
    """The element of a sorted list at round(p / 100 * n + 0.5), rounded half to even."""
    return f"{values}[CAST(greatest(1, least(len({values}), round_even(len({values}) * {p / 100} + 0.5, 0))) AS INT)]"


@query(
    "WITH e AS (SELECT event_type, value, value * (event_id % 7 + 1) / 4 AS audio, user_id AS wall FROM events), "
    "g AS (SELECT event_type, count(*) AS n, sum(audio) AS audio, max(wall) AS wall, avg(value) AS a, list_sort(list(value)) AS t, list_sort(list(value / audio) FILTER (audio > 0)) AS f FROM e GROUP BY event_type) "
    "SELECT event_type, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / wall, 6) AS requests_per_s, round(audio / wall, 4) AS audio_per_s, round(a, 4) AS latency_avg, "
    + ", ".join(f"{bench_sql('t', p)} AS latency_p{p}" for p in (50, 95, 99)) + f", round({bench_sql('f', 50)}, 6) AS rtf_p50 FROM g"
)
def level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per level with all its figures."""
    events = read(spark, sf_dir, "events").withColumn("audio", F.expr("value * (event_id % 7 + 1) / 4"))
    report = metrics.level_report(events, "event_type", "value", "audio", "user_id")
    rounded = {"requests_per_s": 6, "audio_per_s": 4, "latency_avg": 4, "rtf_p50": 6}
    return report.select("event_type", "n", *(F.round(c, rounded[c]).alias(c) if c in rounded else c for c in report.columns[2:]))


NORM_SQL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_à-öø-ÿ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT item_id, levenshtein(a, b) / CAST(length(a) AS DOUBLE) AS cer FROM (SELECT item_id, {NORM_SQL.format('text')} AS a, {NORM_SQL.format(chr(39).join(['replace(text, ', 'th', ', ', 't', ')']))} AS b FROM benchmark)")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates of perturbed items."""
    return read(spark, sf_dir, "benchmark").select("item_id", metrics.character_error_rate("text", F.replace("text", F.lit("th"), F.lit("t"))).alias("cer"))


@query(f"SELECT item_id, CAST(len(list_filter(w, lambda x: ends_with(x, 'th'))) AS DOUBLE) / len(w) AS wer FROM (SELECT item_id, string_split({NORM_SQL.format('text')}, ' ') AS w FROM benchmark)")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of items whose words ending in th are changed."""
    return read(spark, sf_dir, "benchmark").select("item_id", metrics.word_error_rate("text", F.regexp_replace(metrics.comparison_form("text"), r"th(?= |$)", "qqz")).alias("wer"))


@query("SELECT event_type, median(v) AS median, CAST(count(*) AS BIGINT) AS runs FROM (SELECT event_type, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def median_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over days of each day's largest value."""
    days = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return metrics.median_of_runs(days, ["event_type"], "day", "value")


def spoken_sql(english: bool) -> str:
    """The composed sentence in words: a date whose day can be a month is read month first."""
    say = S.cardinal_en if english else S.cardinal_ms
    day = say("CAST(CASE WHEN day(o_orderdate) <= 12 THEN month(o_orderdate) ELSE day(o_orderdate) END AS BIGINT)")
    month = S.words(dates.MONTHS_EN if english else dates.MONTHS_MS) + "[CAST(CASE WHEN day(o_orderdate) <= 12 THEN day(o_orderdate) ELSE month(o_orderdate) END AS INT)]"
    rest = " untuk three to five kg, diskaun ten percent di zero one two, three four five six seven eight nine,." if english else " untuk tiga hingga lima kg, diskaun sepuluh peratus di kosong satu dua, tiga empat lima enam tujuh lapan sembilan,."
    return f"'Harga ' || {amount_sql('ringgit', 'sen', say, '')} || ' pada ' || ({day}) || ' ' || {month} || ' ' || ({say('CAST(year(o_orderdate) AS BIGINT)')}) || '{rest}'"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {spoken_sql(True)} ELSE {spoken_sql(False)} END AS said FROM orders")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over composed sentences."""
    said = F.concat(F.lit("**Harga** "), price("RM"), F.lit(" pada "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" untuk 3-5 kg, diskaun 10% di 012-3456789!"))
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
    rows = orders.select("o_orderkey", said.alias("said"), (F.col("o_orderkey") % 2 == 0).alias("english"))
    return normalizer.normalize_different(rows, "said", "english").select("o_orderkey", "said")
