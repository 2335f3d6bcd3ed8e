"""Dates, times and years in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.numbers import cardinal_en, cardinal_ms, ordinal_en, words
from tessitura.functions.rewriting import Text, col, first_upper, let, lookup, regex_map

# --- Fixed values: months -----------------------------------------------------------------------------
MONTHS_MS = ["Januari", "Februari", "Mac", "April", "Mei", "Jun", "Julai", "Ogos", "September", "Oktober", "November", "Disember"]
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Slang in dates and what it stands for.
DATE_WORDS = {
    "awk": "awak", "ngkau": "engkau", "lps": "lalu", "lepas": "lalu", "mnggu": "minggu", "bln": "bulan", "skrg": "sekarang", "thun": "tahun",
    "hri": "hari", "minute": "minit", "mnit": "minit", "sec": "saat", "second": "saat", "yesterday": "semalam", "kelmarin": "kelmarin",
    "smalam": "semalam", "dpan": "depan", "dpn": "depan", "esk": "esok", "pagi": "AM", "pgi": "AM", "morning": "AM",
    "tengahari": "PM", "tngahari": "PM", "petang": "PM", "ptg": "PM", "malam": "PM", "semalam": "semalam", "pkul": "pukul",
}
#: Words that say which part of a day a time lies in, and those that move the hour.
PARTS = r"a\.m\.|p\.m\.|am|pm|pagi|pgi|morning|tengahari|tngahari|petang|ptg|malam|hours|hour|hrs|jam"
TIME = rf"(?i)^\s*(?:pkul|pukul|kul)?\s*([0-2]?[0-9])(?:[:.]([0-5][0-9]))?(?:[:.]([0-5][0-9]))?(?:\s*({PARTS}))?"


def parse_time(text: Text) -> Column:
    """(hour, minute, second); Malay parts of the day move the hour, ``am`` and ``pm`` do not."""
    text = col(text)
    hour, minute, second = (F.coalesce(F.nullif(F.regexp_extract(text, TIME, i), F.lit("")).try_cast("int"), F.lit(0)) for i in (1, 2, 3))
    part = F.lower(F.regexp_extract(text, TIME, 4))
    moved = (
        F.when(part.isin("pagi", "pgi", "morning") & (hour == 12), 0)
        .when(part.isin("tengahari", "tngahari") & hour.between(1, 6), hour + 12)
        .when(part.isin("petang", "ptg") & (hour < 12), hour + 12)
        .when((part == "malam") & hour.between(1, 11), hour + 12)
        .otherwise(hour)
    )
    return F.when(text.rlike(TIME) & (moved < 24), F.struct(moved.alias("hour"), minute.alias("minute"), second.alias("second")))


def time_words(text: Text, english: bool = False) -> Column:
    """``pukul dua satu minit pagi`` or ``at two one minit am``; what is no time comes back unchanged."""
    say = cardinal_en if english else cardinal_ms
    minute, second, morning, noon, night = (" minute", " saat", "am", "pm", "pm") if english else (" minit", " saat", "pagi", "petang", "malam")

    def read(t: Column) -> Column:
        shown = F.array(F.when(t["hour"] % 12 == 0, 12).otherwise(t["hour"] % 12), F.when(t["minute"] > 0, t["minute"]), F.when(t["second"] > 0, t["second"]))
        part = F.when(t["hour"] < 12, morning).when(t["hour"] < 19, noon).otherwise(night)
        behind = lambda w, i, word: F.coalesce(F.concat(F.lit(" "), F.get(w, i), F.lit(word)), F.lit(""))
        said = F.transform(shown, lambda n: F.when(n.isNotNull(), say(n)))
        return F.when(t.isNotNull(), let(said, lambda w: F.concat(F.lit("at" if english else "pukul"), behind(w, 0, ""), behind(w, 1, minute), behind(w, 2, second), F.lit(" "), part)))

    return F.coalesce(let(parse_time(text), read), col(text))


def parse_date(text: Text) -> Column:
    """Year first, else month first, else day first if the month can't be."""
    text = F.regexp_replace(col(text), "[/.]", "-")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-M-d", "M-d-yyyy", "d-M-yyyy")))


def date_words(text: Text, english: bool = False) -> Column:
    """``sebelas Januari dua ribu dua puluh satu``."""
    say, names = (cardinal_en, MONTHS_EN) if english else (cardinal_ms, MONTHS_MS)
    both = lambda d: F.transform(F.array(F.dayofmonth(d), F.year(d)), say)
    said = let(parse_date(text), lambda d: F.when(d.isNotNull(), let(both(d), lambda w: F.concat(F.get(w, 0), F.lit(" "), F.get(words(names), F.month(d) - 1), F.lit(" "), F.get(w, 1)))))
    return F.coalesce(said, col(text))


#: The beginnings of months' names, in both languages, by number.
BEGINNINGS = ["jan", "feb", "mac|mar", "apr", "mei|may", "jun", "jul", "aug|ogo", "sep", "okt|oct", "nov", "dis|dec"]


def date_parts(text: Text) -> Column:
    """(day, month, year, named) of a date in figures or with a month's name; ``year`` is null where none of four digits is given, ``named``
    the month as it is written where it comes first and no year does. All null for what is no date."""

    def read(t: Column) -> Column:
        month = F.lit(None).cast("int")
        for i, names in reversed(list(enumerate(BEGINNINGS, 1))):
            month = F.when(t.rlike(rf"(?i)\b(?:{names})[a-z]*\b"), i).otherwise(month)
        year = F.nullif(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
        day = F.regexp_extract(F.regexp_replace(t, r"\b(?:19|20)\d{2}\b", ""), r"(?<!\d)(\d{1,2})(?!\d)", 1)
        named = F.when(year.isNull(), first_upper(F.regexp_extract(t, r"^\s*([A-Za-z]+)\s+\d{1,2}$", 1))).otherwise("")
        figures = parse_date(t)
        pair = F.nullif(F.regexp_extract(t, r"^(\d{1,2})-(\d{1,2})$", 2), F.lit("")).try_cast("int")  # a failing cast throws inside
        part = lambda d, m, y, n: F.struct(d.cast("string").alias("day"), m.alias("month"), y.cast("string").alias("year"), n.alias("named"))
        none = F.lit(None).cast("string")
        return (
            F.when(month.isNotNull() & day.try_cast("int").between(1, 31), part(day, month, year, named))
            .when(pair.between(1, 12), part(F.regexp_extract(t, r"^(\d{1,2})", 1), pair, none, F.lit("")))
            .otherwise(let(figures, lambda d: part(F.dayofmonth(d), F.month(d), F.year(d), F.lit(""))))
        )

    return let(col(text), read)


def spoken_date(text: Text, english: bool = False) -> Column:
    """A date in words, with its year only where it is given; what is none comes back unchanged."""
    say, names = (cardinal_en, MONTHS_EN) if english else (cardinal_ms, MONTHS_MS)

    def read(d: Column) -> Column:
        said = F.transform(F.array(d["day"], d["year"]), lambda n: F.when(n.isNotNull(), say(n)))
        return let(said, lambda w: F.when(d["named"] != "", F.concat_ws(" ", d["named"], F.get(w, 0))).when(d["month"].isNotNull(), F.concat_ws(" ", F.get(w, 0), F.get(words(names), d["month"] - 1), F.get(w, 1))))

    return F.coalesce(let(date_parts(text), read), col(text))


def year_words(text: Text, english: bool = False) -> Column:
    """A year in two pairs; as one number if its second digit is 0 and it isn't of this century, or if it is 2000."""
    text = col(text).cast("string")
    say = cardinal_en if english else cardinal_ms
    whole = ((F.substring(text, 2, 1) == "0") & ~F.startswith(text, F.lit("20"))) | (text == "2000")
    return F.when(~text.rlike(r"^\d{4}$"), text).when(whole, say(text)).otherwise(F.concat(say(F.substring(text, 1, 2)), F.lit(" "), say(F.substring(text, 3, 2))))


def hijri_words(text: Text) -> Column:
    """``1444H`` as cardinal and ``Hijrah``."""
    return F.concat(cardinal_ms(F.regexp_replace(col(text), r"\s*[Hh]$", "")), F.lit(" Hijrah"))


def hari_bulan_words(text: Text) -> Column:
    """``12hb`` as ``dua belas hari bulan``."""
    return F.concat(cardinal_ms(F.regexp_replace(col(text), "[Hh][Bb]$", "")), F.lit(" hari bulan"))


def day_month_words(day: Text, month: Text, english: bool = False) -> Column:
    """``pada 3/4`` in words."""
    if english:
        return F.concat(F.lit("on the "), ordinal_en(day), F.lit(" day of the "), ordinal_en(month), F.lit(" month"))
    return F.concat(F.lit("pada "), cardinal_ms(day), F.lit(" hari bulan "), cardinal_ms(month))


def relative_date(text: Text, as_of: Text) -> Column:
    """``3 hari lalu``, ``esok``, ``2 minggu depan`` and the like, from an explicit day; else null."""
    text, day = F.lower(col(text)), col(as_of).cast("date")
    n = F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(1))
    unit = F.regexp_extract(text, r"(minggu|mnggu|bulan|tahun|thun|hari|hri)", 1)
    n = n * F.when(text.rlike(r"(lalu|lepas|lps)$"), -1).otherwise(1)
    moved = F.when(unit.isin("minggu", "mnggu"), F.date_add(day, n * 7)).when(unit.isin("hari", "hri"), F.date_add(day, n)).when(unit == "bulan", F.add_months(day, n)).when(unit.isin("tahun", "thun"), F.add_months(day, n * 12))
    return F.when(text.rlike(r"^(semalam|smalam|kelmarin|yesterday)$"), F.date_sub(day, 1)).when(text.rlike(r"^(esok|esk)$"), F.date_add(day, 1)).when(text.rlike(r"(lalu|lepas|lps|depan|dpan|dpn)$"), moved)


def plain_date_words(text: Text) -> Column:
    """A date's slang in standard words, longest first, in one pass."""
    keys = "|".join(sorted(DATE_WORDS, key=len, reverse=True))
    return regex_map(col(text), keys, lambda m: lookup(m, DATE_WORDS))


def dates_beside_times(text: Text) -> Column:
    """All (clock, day) pairs of a time and a date with one blank between, in either order."""
    clock, day = r"\d{1,2}:\d{2}(?::\d{2})?", r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})"
    found = F.regexp_extract_all(col(text), F.lit(rf"{clock} {day}|{day} {clock}"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, f"({clock})", 1).alias("clock"), F.regexp_extract(m, f"({day})", 1).alias("day")))
