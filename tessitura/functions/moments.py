"""Dates and times of a text: what is written, in one standard form, and the moment that it names.

Sixteen kinds of matches are looked for, each over the whole text, so that kinds may overlap: dates in figures or with a month's name, clock times, times after
``pukul``, days and spans before and after now, and a time beside a day in either order. A kind is looked for only in texts that have what all
its matches have. What is part of a longer match goes.

A moment is told from an expression and an explicit ``as_of``; nothing asks the clock of a machine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.dates import BEGINNINGS, plain_date_words
from tessitura.functions.rewriting import Text, col, let
from tessitura.operators.tokens import MORE, TOKENS

CLOCK, PUKUL, DATE, NEAR_DAY = TOKENS["time"], TOKENS["time_pukul"], TOKENS["date"], MORE["yesterday_tomorrow"]
#: Kind, pattern, and a cheap pattern without which a text has no match. A pair is found only where both of its sides are.
KINDS = {
    "date": (DATE, r"[0-9]"),
    "past": (MORE["past_date"], r"lalu|lepas|lps"),
    "now": (MORE["now_date"], r" (?:ini|ni)\b"),
    "future": (MORE["future_date"], r"dlm|dalam"),
    "near_day": (NEAR_DAY, r"yesterday|malam|kelmarin|es(?:o)?k"),
    "next": (MORE["depan_date"], r"d(?:e)?p(?:a)?n"),
    "time": (CLOCK, r"[0-9]"),
    "pukul": (PUKUL, r"(?:pkul|kul)\s*\.?[0-9]"),
}
PAIRS = [("time", "date"), ("date", "time"), ("pukul", "date"), ("date", "pukul"), ("time", "near_day"), ("near_day", "time"), ("pukul", "near_day"), ("near_day", "pukul")]
#: Keys up to which each is compared with each; more are looked up in the set of all pieces of the lengths that occur.
COMPARED = 128
#: Larger counts of days, months and so on name no moment.
MOST = 9999


def matches_of(text: Text) -> Column:
    """All matches of all kinds as array of (kind, found), kind after kind; pairs are called after both sides. Null for null."""

    def all_of(kind: str, pattern: str, guard: Column, t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(f"(?U){pattern}"), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("found")))
        return F.when(guard, found).otherwise(F.array().cast("array<struct<kind:string,found:string>>"))

    def read(t: Column) -> Column:
        single = F.array(*(all_of(kind, pattern, t.rlike(guard), t) for kind, (pattern, guard) in KINDS.items()))

        def paired(s: Column) -> Column:
            has = {kind: F.size(F.get(s, i)) > 0 for i, kind in enumerate(KINDS)}
            pairs = [all_of(f"{a} {b}", f"(?:{KINDS[a][0]}) (?:{KINDS[b][0]})", has[a] & has[b], t) for a, b in PAIRS]
            return F.concat(F.flatten(s), *pairs)

        return let(single, paired)

    return F.when(col(text).isNotNull(), let(col(text), read))


def standard(found: Column) -> Column:
    """A match with colons for dots, slang in standard words and single blanks."""
    return F.trim(F.regexp_replace(plain_date_words(F.replace(found, F.lit("."), F.lit(":"))), " +", " "))


def longest_only(keys: Column, compared: int = COMPARED) -> Column:
    """The different strings of an array that are part of no longer one, in the order of their first places."""

    def few(k: Column) -> Column:
        return F.filter(k, lambda x: ~F.exists(k, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))

    def many(k: Column) -> Column:
        lengths = F.array_distinct(F.transform(k, F.length))
        pieces = F.transform(k, lambda y: F.flatten(F.transform(F.filter(lengths, lambda n: n < F.length(y)), lambda n: F.transform(F.sequence(F.lit(1), F.length(y) - n + 1), lambda i: F.substring(y, i, n)))))
        return F.array_except(k, F.flatten(pieces))

    return let(F.array_distinct(keys), lambda k: F.when(F.size(k) <= compared, few(k)).otherwise(many(k)))


def expressions(text: Text) -> Column:
    """The text's expressions of time in standard form, none part of another."""
    return longest_only(F.filter(F.transform(matches_of(text), lambda m: standard(m["found"])), lambda k: k != ""))


def clock_of(t: Column) -> Column:
    """Seconds since midnight of the first clock time, -1 for one that no day has; null without one."""
    part = r"\s*(AM|PM|am|pm|a:m:|p:m:|jam|hours|hour|hrs)"
    pattern = rf"(?:(?:pukul|pkul|kul)\s*([0-9]{{1,2}})(?::([0-5][0-9]))?(?::([0-5][0-9]))?(?:{part})?|(?<![0-9])([0-9]{{1,2}}):([0-5][0-9])(?::([0-5][0-9]))?(?:{part})?|(?<![0-9])([0-9]{{1,2}}){part})"

    def read(m: Column) -> Column:
        group = lambda *at: F.coalesce(*(F.nullif(F.regexp_extract(m, pattern, i), F.lit("")) for i in at))
        zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))

        def told(g: Column) -> Column:
            half = F.lower(F.left(g["part"], F.lit(1)))
            hour = F.when((half == "p") & (g["hour"] < 12), g["hour"] + 12).when((half == "a") & (g["hour"] == 12), 0).otherwise(g["hour"])
            return F.when(hour < 24, hour * 3600 + g["minute"] * 60 + g["second"]).otherwise(-1)

        parts = F.struct(group(1, 5, 9).cast("int").alias("hour"), zero(group(2, 6)).alias("minute"), zero(group(3, 7)).alias("second"), F.coalesce(group(4, 8, 10), F.lit("")).alias("part"))
        return F.when(m != "", let(parts, told))

    return let(F.regexp_extract(t, pattern, 0), read)


#: A date in figures, with a year of four digits first or last. Dots stand as colons in standard form.
IN_FIGURES = r"(?<![0-9])(?:[12][0-9]{3}[-/:][0-9]{1,2}[-/:][0-9]{1,2}|[0-9]{1,2}[-/:][0-9]{1,2}[-/:][12][0-9]{3})(?![0-9])"


def day_of(t: Column, as_of: Column) -> Column:
    """The day of a date: year first, else month first, else day first; with a month's name, this year if none is given. Null without one."""

    def named(names: Column) -> Column:
        month = F.lit(None).cast("int")
        for i, stems in reversed(list(enumerate(BEGINNINGS, 1))):
            month = F.when(names.rlike(rf"(?i)(?<![a-z])(?:{stems})[a-z]*"), i).otherwise(month)
        count = F.regexp_extract_all(names, F.lit(r"(?<![0-9])[0-9]+"), F.lit(0))

        def read(n: Column) -> Column:
            long = F.get(F.filter(n, lambda x: F.length(x) == 4), 0)
            short = F.filter(n, lambda x: F.length(x) <= 2)
            given = F.coalesce(long, let(F.get(short, 1), lambda y: F.when(y.cast("int") < 69, F.concat(F.lit("20"), F.lpad(y, 2, "0"))).when(y.isNotNull(), F.concat(F.lit("19"), y))))
            year = F.coalesce(given, F.year(as_of).cast("string"))
            return F.try_to_timestamp(F.concat_ws("-", year, month.cast("string"), F.get(short, 0)), F.lit("yyyy-M-d"))

        return F.when(month.isNotNull(), let(count, read))

    def figures(m: Column) -> Column:
        return F.when(m != "", let(F.regexp_replace(m, "[/:]", "-"), lambda d: F.coalesce(*(F.try_to_timestamp(d, F.lit(f)) for f in ("yyyy-M-d", "M-d-yyyy", "d-M-yyyy")))))

    clock = r"(?<![0-9])[0-9]{1,2}:[0-5][0-9](?::[0-5][0-9])?(?:\s*(?:AM|PM|am|pm))?|[0-9]{1,2}\s*(?:AM|PM|am|pm|jam|hours|hour|hrs)\b|(?:pukul|pkul|kul)\s*[0-9]{1,2}"
    return F.coalesce(let(F.regexp_extract(t, IN_FIGURES, 0), figures), named(F.regexp_replace(t, clock, " ")))


def shifted_from(t: Column, as_of: Column) -> Column:
    """``as_of`` moved by what a relative expression says; null for what is none."""
    unit = F.regexp_extract(t, r"(minggu|bulan|tahun|hari|jam|minit|saat)\s*(?:lalu|depan|$)", 1)
    ahead = F.regexp_extract(t, r"(?:dlm|dalam)\s*([0-9]+)", 1)
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"([0-9]+)\s*(?:minggu|bulan|tahun|hari|jam|minit|saat)", 1), F.lit("")), F.lit("1")).try_cast("int")
    sign = F.when(t.rlike("lalu"), -1).when(t.rlike("depan") | (ahead != ""), 1)
    steps = F.when(n <= MOST, n * sign)
    amount = lambda *units: F.when(unit.isin(*units), steps).otherwise(0)

    def moved(s: Column) -> Column:
        return as_of + F.make_interval(F.lit(0), amount("bulan") + amount("tahun") * 12, amount("minggu"), amount("hari"), amount("jam"), amount("minit"), amount("saat"))

    return (
        F.when(t.rlike("semalam|kelmarin"), as_of - F.expr("INTERVAL '1' DAY"))
        .when(t.rlike("esok"), as_of + F.expr("INTERVAL '1' DAY"))
        .when((unit != "") & steps.isNotNull(), moved(steps))
        .when(t.rlike(r"\b(?:sekarang|jam|tahun|saat|minit) (?:ini|ni)\b"), as_of)
    )


def moment_of(expression: Text, as_of: Text) -> Column:
    """The moment that an expression in standard form names, seen from ``as_of``.

    A date lies at midnight and a time on the day of ``as_of``; a day or a span before or after now keeps the clock of ``as_of``; a time beside a day holds on it.
    Null for days and times that do not exist, for counts over 9999 and for years outside 1 to 9999.
    """
    now = col(as_of).cast("timestamp")

    def read(x: Column) -> Column:
        t, at = x["t"], x["at"]
        parts = F.struct(day_of(t, at).alias("day"), shifted_from(t, at).alias("shifted"), clock_of(F.regexp_replace(t, IN_FIGURES, " ")).alias("clock"), at.alias("at"))

        def whole(p: Column) -> Column:
            on = lambda day: F.date_trunc("DAY", day) + F.make_dt_interval(secs=p["clock"].cast("decimal(18,6)"))
            clocked = p["clock"].isNotNull()
            found = (
                F.when(p["clock"] < 0, None)
                .when(p["day"].isNotNull(), F.when(clocked, on(p["day"])).otherwise(p["day"]))
                .when(p["shifted"].isNotNull(), F.when(clocked & ~t.rlike(r"jam\s*(?:lalu|depan|ini|ni)|(?:dlm|dalam)\s*[0-9]+jam"), on(p["shifted"])).otherwise(p["shifted"]))
                .when(clocked, on(p["at"]))
            )
            return let(found, lambda f: F.when(F.year(f).between(1, MOST), f))

        return let(parts, whole)

    return let(F.struct(col(expression).alias("t"), now.alias("at")), read)


def moments(text: Text, as_of: Text) -> Column:
    """A map from the text's expressions of time to the moments that they name; those that name none map to null."""
    keys = expressions(text)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), moment_of(k, as_of).alias("value"))))
