"""The text normaliser: mark-up, characters, contractions, ranges, scripts, the cascade over tokens, pronunciation, final dot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import dates, numbers, text, words
from tessitura.functions.chinese import CJK, KANA, chinese_dominant, normalize_chinese
from tessitura.functions.moments import moments
from tessitura.functions.rewriting import collapse, regex_map
from tessitura.operators.tokens import TOKENS
from tessitura.plans.cascade import SERVICE, Rules, speak


def spoken_url(url: Column) -> Column:
    """Scheme in capitals, dots by name, digits one by one."""
    scheme = F.upper(F.regexp_extract(url, "^(https?)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"\.", " dot ")
    return F.trim(F.concat(scheme, F.lit(" "), regex_map(rest, r"\d+", lambda d: F.concat(F.lit(" "), numbers.digit_words(d), F.lit(" ")))))


def spoken_email(email: Column, english: bool = False) -> Column:
    """Dots and the sign by name, letters in capitals, digits one by one."""
    return words.space_numbers(F.replace(F.replace(F.upper(email), F.lit("."), F.lit(" dot ")), F.lit("@"), F.lit(" at " if english else " di ")), english)


def spoken_groups(value: Column, english: bool = False, between: str = " ") -> Column:
    """Groups of digits read digit by digit."""
    return F.array_join(F.transform(F.split(value, "-"), lambda g: numbers.digit_words(g, english)), between)


def normalize_segment(df: DataFrame, column: str, english: Column | bool = False, rules: Rules = SERVICE) -> DataFrame:
    """``column`` with all that the cascade knows spoken in Malay or, where ``english`` says so, in English."""
    return speak(df, column, rules, english)


def normalize_text(df: DataFrame, column: str, english: Column | None = None, rules: Rules = SERVICE) -> DataFrame:
    """The whole pipeline: mark-up, white space, characters, contractions, ranges, scripts, cascade, pronunciation, final dot.

    ``english`` says per row which language the cascade speaks (default Malay). Rows that are mainly Chinese take the
    Chinese readings; kana and other scripts stay as they are. Letters and digits that touch are set apart before the cascade.
    """
    df = df.withColumn(column, text.before_map(collapse(text.sanitize_markdown(column))))
    df = df.withColumn("__zh", chinese_dominant(column) | (F.col(column).rlike(f"[{CJK}]") & ~F.col(column).rlike(f"[{KANA}]")))
    df = df.withColumn("__english", F.coalesce(F.lit(False) if english is None else english, F.lit(False)))
    df = df.withColumn(column, text.expand_contractions(column))
    df = normalize_chinese(df.withColumn("__chinese", F.when(F.col("__zh"), F.col(column))), "__chinese")
    ranged = F.when(F.col("__english"), text.range_words(column, english=True)).otherwise(text.range_words(column))
    df = df.withColumn("__spoken", F.when(~F.col("__zh"), text.upper_singles(text.split_alpha_num(ranged))))
    df = speak(df, "__spoken", rules, F.col("__english"))
    out = F.coalesce("__chinese", "__spoken")
    return df.withColumn(column, collapse(text.terminal_dot(text.after_map(text.pronounce(out))))).drop("__zh", "__english", "__chinese", "__spoken")


def normalize_different(df: DataFrame, column: str, english: str | None = None, rules: Rules = SERVICE) -> DataFrame:
    """As ``normalize_text``, but each different text is normalised once for a language and joined back; for tables in which texts come again.

    ``english`` names a boolean column. The different texts are dealt to all cores, since few bytes of them are much work.
    """
    keys = [column] + ([english] if english else [])
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    texts = df.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys))).distinct().repartition(parts).withColumn("__said", F.col("__0"))
    said = normalize_text(texts, "__said", F.col("__1") if english else None, rules)
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return df.join(said, same).withColumn(column, F.col("__said")).drop("__said", *(f"__{i}" for i in range(len(keys))))


def moment(date: Column) -> Column:
    """The day of a date in figures or with a month's name and a year; null for others, which name no day by themselves."""
    named = dates.date_parts(date)
    return F.coalesce(dates.parse_date(date), F.try_to_timestamp(F.concat_ws("-", named["year"], named["month"].cast("string"), named["day"]), F.lit("yyyy-M-d")).cast("date"))


def entities(column: str, as_of: Column | None = None) -> Column:
    """(dates, money) of a text: maps from what is written to the day, and to the canonical amount; the first of equal entries counts.

    With ``as_of``, dates are all expressions of time, relative ones and times beside days too, in standard form and with their moments (see ``moments``).
    """
    bare = F.regexp_replace(F.col(column), TOKENS["ic"], " " if as_of is None else "")
    found = lambda k: F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?U){TOKENS[k]}"), F.lit(0)))
    days = F.map_from_entries(F.transform(found("date"), lambda m: F.struct(m, moment(m)))) if as_of is None else moments(bare, as_of)
    return F.struct(days.alias("dates"), F.map_from_entries(F.transform(found("money"), lambda m: F.struct(m, numbers.money(m)["canonical"]))).alias("money"))


def tts_prompt(voice: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), voice, F.lit(": "), content, F.lit("<|speech_start|>"))


def vc_prompt(reference: Column, codes: Column, content: Column) -> Column:
    """The prompt that continues a reference: its text, its codes, then the text to speak."""
    spoken = F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<|s_"), c.cast("string"), F.lit("|>"))), "")
    return F.concat(F.lit("<|im_start|>"), reference, F.lit("<|speech_start|>"), spoken, F.lit("<|im_end|><|im_start|>"), content, F.lit("<|speech_start|>"))


def backend_request(prompt: Column, model: str, max_tokens: int = 1024, temperature: float = 0.7, repetition_penalty: float = 1.15) -> Column:
    """The JSON body of a completion request."""
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), F.lit(repetition_penalty).alias("repetition_penalty"), F.lit(True).alias("stream")))
