"""The cascade of the text normaliser: every token is spoken by the first rule that knows it.

A text is cut into tokens, and tokens that are read together (``ke - 3``, ``3 / 4``, ``tahun 1999``) become one group: the tokens are joined by a
mark, and one pattern cuts the joined text into groups from the left, so a token that a group has taken starts none of its own. Each group
gets its kind by one CASE in the order of the rules, then the numbers that are to be spoken in it. All numbers of all groups are spoken by
one expression for each language, and a second CASE puts the words together. A text is never taken apart into rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import dates, numbers, text, words
from tessitura.functions.rewriting import collapse, first_upper, let, lookup, regex_map
from tessitura.operators.tokens import TOKENS, tokenize

#: Stands between tokens; no text has it.
SEP = "\x1f"

# --- Fixed values: words that the cascade looks for ----------------------------------------------------------
NUMBER = r"\d+(?:\.\d+)?"
ROMAN = "VXILD"
NOT_NAMES = ["KE", "PADA", "RM", "SEN", "HINGGA"]
NOT_MALAY = ["pada", "ke", "tahun", "thun"]
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
UNITS = ("temperature", "distance", "volume", "duration", "weight", "data_size")
MONTHS_EN = "january|february|march|april|may|june|july|august|september|october|november|december"

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Rules:
    """Which rules speak, and what they know of words: functions from a token in lower case to a boolean, and a table of slang.

    ``english``, ``malay`` and ``place`` may look a token up anywhere an expression can (``isin``, a map, a UDF over Arrow batches). ``score`` gives the
    likelihood of a word; below ``least_score`` it stays as it is.
    """

    text: bool = True
    word_rules: bool = True
    elongated: bool = True
    url: bool = False
    email: bool = False
    phone: bool = True
    year: bool = True
    date: bool = True
    time: bool = True
    until: bool = True
    pada: bool = True
    fraction: bool = True
    money: bool = True
    units: bool = True
    percent: bool = True
    ic: bool = True
    ic_dashes: bool = False
    number: bool = True
    times: bool = True
    cardinal: bool = True
    cardinal_title: bool = True
    ordinal: bool = True
    contractions: bool = True
    english: Check | None = None
    malay: Check | None = None
    place: Check | None = None
    score: Check | None = None
    least_score: float = 1e-4
    slang: dict[str, str] | None = None
    translate: Check | None = None
    spell: Check | None = None


#: What a speech service asks for.
SERVICE = Rules(text=False, word_rules=False, until=False, cardinal=False, ordinal=False, url=True, email=True)


def composites(r: Rules) -> list[tuple[str, str]]:
    """(kind, pattern) of groups of several tokens."""
    s, n = SEP, NUMBER
    found = [
        ("ke_number", f"(?i:ke){s}-{s}{n}", r.ordinal),
        ("ke_roman", f"(?i:ke){s}-{s}[^{s}]*[{ROMAN}][^{s}]*", r.ordinal),
        ("until", f"{n}{s}-{s}{n}", r.until),
        ("pada", f"(?i:pada){s}{n}{s}[/-]{s}{n}", r.pada),
        ("years", rf"(?:t(?i:ahun|hun)){s}\d{{4}}{s}-{s}(?i:an)", r.year),
        ("year", rf"(?:t(?i:ahun|hun)){s}\d{{4}}", r.year),
        ("fraction", f"{n}{s}/{s}{n}", r.fraction),
        ("year_an", rf"\d{{4}}{s}-{s}(?i:an)", r.fraction and r.year),
        ("money_cent", rf"(?:[$€£¢]|RM|rm)\s*\d[^{s}]*{s}(?i:sen|cent)", r.money),
        ("day_month", rf"[1-9]\d*{s}(?i:{MONTHS_EN})", r.date),
    ]
    return [(k, p) for k, p, on in found if on]


def kind_of(w: Column, r: Rules) -> Column:
    """The first rule that knows a group."""
    return let(F.lower(w), lambda low: known_as(w, low, r))


def known_as(w: Column, low: Column, r: Rules) -> Column:
    never = F.lit(False)
    has = lambda t, *kinds: t.rlike("(?U)" + "|".join(f"(?:{TOKENS[k]})" for k in kinds))
    digit, first = w.rlike("[0-9]"), w.rlike(r"^\p{Lu}")
    english = r.english(low) if r.english else never
    longer = F.length(w) > 1
    doubled = low.rlike(r"(.)\1$")
    cut = F.left(low, F.length(low) - 1)
    dated = has(low, "date")
    whole = [
        (words.is_punctuation(w) | words.is_ignored(w), "as_is"),
        (digit & low.rlike("(?U)" + TOKENS["ic"]), "ic" if r.ic else "as_is"),
        (F.contains(w, F.lit("#")) & has(low, "hashtag"), "as_is"),
        (has(low, "url"), "url" if r.url else "as_is"),
        (F.contains(w, F.lit("@")) & has(low, "email"), "email" if r.email else "as_is"),
        (digit & has(low, "phone"), "phone" if r.phone else "as_is"),
        (F.contains(w, F.lit("@")) & has(low, "user"), "as_is"),
        (has(low, "word_dash"), "dashes"),
        (digit & has(w, "passport"), "spelled"),
        *([(r.score(low) <= r.least_score, "as_is")] if r.score else []),
    ]
    if r.slang and r.word_rules:
        whole.append((first & ~(digit & (has(low, "money") | dated)) & low.isin(list(r.slang)), "slang"))
    if r.text:
        whole.append((first & ~(digit & (has(low, "money") | dated)) & low.isin(list(words.TITLES)), "title"))
    whole.append((first & ~F.upper(w).isin(NOT_NAMES) & ~(digit & (has(low, "money") | dated)), "name"))
    if r.english:
        stem = F.lower(words_stem(w))
        whole += [(longer & r.english(stem), "english"), (longer & stem.rlike(r"(.)\1$") & r.english(F.left(stem, F.length(stem) - 1)), "english_cut")]
    if r.malay:
        whole += [(longer & ~low.isin(NOT_MALAY) & r.malay(low), "as_is"), (longer & ~low.isin(NOT_MALAY) & doubled & r.malay(cut), "cut")]
    if r.place:
        whole.append((r.place(low), "place"))
    if r.slang and r.word_rules:
        whole.append((low.isin(list(r.slang)), "slang"))
    if r.text:
        whole.append((w.rlike("^x.") & ~english, "negated"))
    if r.ordinal:
        whole.append((low == "ke", "ke"))
    numeric = [
        (has(low, "money"), "money" if r.money else "as_is"),
        (has(low, *UNITS), "unit" if r.units else "as_is"),
        (has(low, "percent"), "percent" if r.percent else "as_is"),
        (dated, "date"),
        (has(w, "hijri_year"), "hijri"),
        (has(w, "hari_bulan"), "hari_bulan"),
        (has(low, "pada_tarikh"), "pada_tarikh"),
        (has(low, "time", "time_pukul"), "time" if r.time else "as_is"),
        (has(low, "number") & low.rlike(r"^0[^.]*$"), "digits" if r.number else "as_is"),
        *([(low.rlike(r"(?U)^[^.]*x$") & F.left(low, F.length(low) - 1).rlike("(?U)" + TOKENS["number"]), "times")] if r.times else []),
        *([(w.rlike(r"^-?[\d,]+(\.\d+)?$"), "cardinal")] if r.cardinal else []),
        *([(w.rlike(r"^(ke-?)?[\d,]+$"), "ordinal")] if r.ordinal else []),
        *([(has(low, "number_with_shortform"), "shortform")] if r.cardinal else [(has(low, "number_with_shortform"), "as_is")]),
        *([(has(w, "number"), "cardinals" if r.cardinal else "spelled" if r.number else "as_is")]),
    ]
    out = F.lit("rest")
    if r.ordinal:
        out = F.when(w.rlike(f"^(ke-)?[MCDXLIV]*[{ROMAN}][MCDXLIV]*$"), "roman").otherwise(out)
    out = F.when(~digit & has(low, "duration"), "as_is").otherwise(out)
    for cases, guard in ((numeric, digit), (whole, F.lit(True))):
        inner = out
        for test, kind in reversed(cases):
            inner = F.when(test, kind).otherwise(inner)
        out = F.when(guard, inner).otherwise(out) if guard is digit else inner
    for kind, pattern in reversed(composites(r)):
        out = F.when(F.contains(w, F.lit(SEP)) & w.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def words_stem(w: Column) -> Column:
    """A word without the digit that says how often it is repeated."""
    return text.check_repeat(w)["stem"]


def number_parts(w: Column, kind: Column, english: Column) -> list[Column]:
    """Up to three numbers to be spoken in a group, and the words around them, as struct(a, b, c, x, y)."""
    at = lambda i: F.get(F.split(w, SEP), i)
    none = F.lit(None).cast("string")

    def row(a: Column = none, b: Column = none, c: Column = none, x: Column = none, y: Column = none) -> Column:
        return F.struct(*(v.cast("string").alias(n) for v, n in zip((a, b, c, x, y), "abcxy")))

    def year(y: Column) -> Column:
        whole = ((F.substring(y, 2, 1) == "0") & ~F.startswith(y, F.lit("20"))) | (y == "2000")
        return let(y, lambda v: F.when(whole, row(v)).otherwise(row(F.substring(v, 1, 2), F.substring(v, 3, 2))))

    def in_money(a: Column) -> Column:
        part = F.regexp_extract(a["shown"], r"\.(\d+)$", 1)
        padded = F.when(F.length(part) == 1, F.concat(part, F.lit("0"))).otherwise(part)
        return F.when(a.isNotNull(), row(F.regexp_extract(a["shown"], r"^(\d+)", 1), F.nullif(padded, F.lit("")), none, a["unit"], a["cent"])).otherwise(row(x=w))

    def in_date(d: Column) -> Column:
        names = numbers.words(dates.MONTHS_EN), numbers.words(dates.MONTHS_MS)
        month = F.when(english, F.get(names[0], d["month"] - 1)).otherwise(F.get(names[1], d["month"] - 1))
        return F.when(d["named"] != "", row(d["day"], x=d["named"], y=F.lit("month first"))).when(d["month"].isNotNull(), row(d["day"], c=d["year"], x=month)).otherwise(row())

    def in_time(t: Column) -> Column:
        positive = lambda v: F.when(v > 0, v)
        hour = F.when(t["hour"] % 12 == 0, 12).otherwise(t["hour"] % 12)
        part = F.when(t["hour"] < 12, "pagi").when(t["hour"] < 19, "petang").otherwise("malam")
        return F.when(t.isNotNull(), row(hour, positive(t["minute"]), positive(t["second"]), part)).otherwise(row())

    unit, bare = F.regexp_replace(w, "[0-9. ]", ""), F.regexp_replace(w, "[^0-9.]", "")
    return (
        F.when(kind.isin("as_is", "name", "rest"), row())  # most of any text
        .when(kind == "until", row(at(0), at(2)))
        .when(kind == "fraction", row(at(0), at(2)))
        .when(kind == "pada", row(at(1), at(3)))
        .when(kind.isin("year", "years"), year(at(1)))
        .when(kind == "year_an", year(at(0)))
        .when(kind.isin("money", "money_cent"), let(numbers.amount(at(0)), in_money))
        .when(kind == "unit", F.when(bare.rlike(NUMBER), row(bare, x=F.when(english, numbers.unit_name(unit, True)).otherwise(numbers.unit_name(unit)))).otherwise(row(x=w)))
        .when(kind == "percent", row(F.regexp_replace(w, "%", "")))
        .when(kind == "date", let(dates.date_parts(w), in_date))
        .when(kind == "pada_tarikh", let(dates.date_parts(F.regexp_replace(F.lower(w), r"^(?:pada|tarikh)\s+(\d+)\s(\d+)$", "$1-$2")), in_date))
        .when(kind == "time", let(dates.parse_time(w), in_time))
        .when(kind == "hijri", row(F.regexp_replace(w, r"\s*[Hh]$", "")))
        .when(kind == "hari_bulan", row(F.regexp_replace(w, "[Hh][Bb]$", "")))
        .when(kind == "times", row(F.regexp_replace(w, "[xX]$", "")))
        .when(kind == "cardinal", row(w))
        .when(kind == "shortform", row(numbers.shortform(F.lower(w))))
        .otherwise(row())
    )


def softened(w: Column) -> Column:
    """A word that no rule knows with a for its final e behind a consonant."""
    return F.when((F.length(w) > 2) & w.rlike(f"[{CONSONANTS}]e$"), F.concat(F.left(w, F.length(w) - 1), F.lit("a"))).otherwise(w)


def rest_words(word: Column, r: Rules, root: Column | None = None) -> Column:
    """What is said of a word that no rule knows: its table entry, without a doubled last letter, or what speller or translator make of it; repeated as its digit says."""
    short = lambda t: F.left(t, F.length(t) - 1)
    known = lambda t: lookup(t, (r.slang or {} if r.word_rules else {}) | (words.SOUNDS if r.word_rules else {}), F.lit(None).cast("string"))
    other = r.spell or r.translate or (lambda x: x)

    def said(t: Column) -> Column:
        stem = t["stem"]
        return words.repeated(F.coalesce(known(word), F.when((F.length(stem) > 1) & stem.rlike(r"(.)\1$"), short(stem)), other(stem)), t["times"], root)

    return let(text.check_repeat(word), said)


def in_words(g: Column, english: Column, r: Rules, readings: Column | None = None) -> Column:
    """What is said of a group: struct(w, kind, n (struct of a, b, c, x, y), said (the numbers in words)). ``readings`` maps words that no rule knows to arrays of (stem, ending)."""
    w, kind, n = g["w"], g["kind"], g["n"]
    a, b, c = (F.get(g["said"], i) for i in range(3))
    at = lambda i: F.get(F.split(w, SEP), i)
    tongue = lambda en, ms: F.when(english, en).otherwise(ms)
    joined = lambda *parts: F.concat_ws(" ", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    digits_of = lambda t: F.when(english, numbers.digit_words(t, True)).otherwise(numbers.digit_words(t))
    low = F.lower(w)
    letters = lambda dash: F.array_join(F.transform(F.filter(F.split(w, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), digits_of(x)).when(x == "-", dash).otherwise(F.upper(x) if dash is not None else x)), " ")
    # one expression for all kinds that need it: each costs the plan two languages
    dotted = F.replace(F.replace(w, F.lit("://"), F.lit(" ")), F.lit("."), F.lit(" dot "))
    parted = (
        F.when(kind == "url", dotted)
        .when(kind == "email", F.replace(F.replace(F.upper(w), F.lit("."), F.lit(" dot ")), F.lit("@"), tongue(F.lit(" at "), F.lit(" di "))))
        .when((kind == "phone") & (F.size(F.split(w, "-")) == 2), F.replace(w, F.lit("-"), F.lit(" , ")))
    )
    spaced = let(parted, lambda t: F.when(english, words.space_numbers(t, True)).otherwise(words.space_numbers(t)))
    cased_url = F.replace(F.replace(F.replace(spaced, F.lit("https"), F.lit("HTTPS")), F.lit("http"), F.lit("HTTP")), F.lit("www"), F.lit("WWW"))
    ranked = F.when(kind.isin("ke_number", "ke_roman"), F.concat(F.lit("ke-"), at(2))).when(kind == "day_month", at(0)).when(kind.isin("ordinal", "roman"), w)
    ordinal = let(ranked, lambda t: F.when(english, numbers.ordinal(t, True)).otherwise(numbers.ordinal(t)))
    all_cardinals = let(F.when(kind.isin("name", "cardinals"), w), lambda t: F.when(english, words.all_cardinals(t, True)).otherwise(words.all_cardinals(t)))
    year = F.when(b.isNull(), a).otherwise(joined(a, b))
    zero = a.isin("zero", "kosong")
    dayless = joined(a, n["x"])
    repeated = lambda stem: let(text.check_repeat(w), lambda t: words.repeated(stem(t["stem"]), t["times"]))
    short = lambda t: F.left(t, F.length(t) - 1)
    translated = r.translate or (lambda t: t)
    out = (
        F.when((kind == "as_is") | ((kind == "name") & ~w.rlike(r"[\d\- ]")), w)  # most of any text
        .when(kind == "ic", F.array_join(F.transform(F.split(w, "-"), digits_of), " " if not r.ic_dashes else " sempang "))
        .when(kind == "url", cased_url)
        .when(kind.isin("email", "phone"), F.coalesce(spaced, w))
        .when(kind == "dashes", letters(tongue(F.lit("dash"), F.lit("sempang"))))
        .when(kind == "spelled", letters(None))
        .when(kind == "title", words.spoken_title(w))
        .when(kind == "name", all_cardinals if r.cardinal_title else w)
        .when(kind == "english", repeated(lambda t: text.recase(translated(t), w)))
        .when(kind == "english_cut", repeated(lambda t: text.recase(translated(short(t)), w)))
        .when(kind == "cut", short(w))
        .when(kind == "place", first_upper(low))
        .when(kind == "negated", F.concat(F.lit("tak "), F.substring(w, 2, 1 << 30)))
        .when(kind == "ke", "ke")
        .when(kind.isin("ke_number", "ke_roman", "ordinal", "roman"), ordinal)
        .when(kind == "until", joined(a, tongue(F.lit("until"), F.lit("hingga")), b))
        .when(kind == "pada", F.when(english, dates.day_month_words(n["a"], n["b"], True)).otherwise(joined("pada", a, "hari bulan", b)))
        .when(kind == "year", F.concat(tongue(F.lit(""), F.lit("tahun ")), year))
        .when(kind == "years", F.concat(tongue(F.lit(""), F.lit("tahun ")), year, tongue(F.lit("s"), F.lit("an"))))
        .when(kind == "year_an", F.concat(year, F.lit("an")))
        .when(kind == "fraction", joined(a, "per", b))
        .when(kind.isin("money", "money_cent"), F.when(a.isNull(), at(0)).otherwise(joined(F.when(~zero, joined(a, n["x"])), F.when(b.isNotNull(), joined(b, n["y"])))))
        .when(kind == "unit", joined(a, n["x"]))
        .when(kind == "percent", joined(a, tongue(F.lit("percent"), F.lit("peratus"))))
        .when(kind.isin("date", "pada_tarikh"), F.when(n["x"].isNull(), w).when(n["y"].isNotNull(), joined(n["x"], a)).otherwise(joined(dayless, c)))
        .when(kind == "time", F.when(a.isNull(), w).otherwise(joined(
            tongue(F.lit("at"), F.lit("pukul")), a, joined(b, F.when(b.isNotNull(), tongue(F.lit("minute"), F.lit("minit")))), joined(c, F.when(c.isNotNull(), F.lit("saat"))),
            tongue(F.when(n["x"] == "pagi", "am").otherwise("pm"), n["x"]),
        )))
        .when(kind == "hijri", joined(a, "Hijrah"))
        .when(kind == "hari_bulan", joined(a, tongue(F.lit("days of the month"), F.lit("hari bulan"))))
        .when(kind == "digits", digits_of(w))
        .when(kind == "times", joined(a, tongue(F.lit("times"), F.lit("kali"))))
        .when(kind == "day_month", joined(ordinal, at(1)))
        .when(kind.isin("cardinal", "shortform"), a)
        .when(kind == "cardinals", all_cardinals)
    )
    if r.slang and r.word_rules:
        out = out.when(kind == "slang", text.recase(lookup(low, r.slang), w))
    if not r.text:
        return out.when(kind == "rest", w).otherwise(w)
    rest = let(softened(w), lambda t: rest_words(t, r))
    if readings is not None:
        told = F.try_element_at(readings, softened(w))
        rest = F.when(told.isNotNull(), F.array_join(F.transform(told, lambda p: F.concat(rest_words(p["stem"], r, p["root"]), p["ending"])), " ")).otherwise(rest)
    return out.when(kind == "rest", rest).otherwise(w)


def squashed(token: Column, r: Rules) -> Column:
    """Runs of a letter cut to two in words that no pattern guards."""
    guarded = "|".join(TOKENS[k] for k in ("email", "url", "hashtag", "phone", "money", "date", "ic", "user", "number"))
    english = r.english(F.lower(token)) if r.english else F.lit(False)
    plain = token.rlike(r"(.)\1") & ~token.rlike(r"^\p{Lu}") & ~F.startswith(F.lower(token), F.lit("ke-")) & ~token.rlike(f"(?U){guarded}") & ~english
    return F.when(plain, F.regexp_replace(token, r"(.)\1{2,}", "$1$1")).otherwise(token)


def grouped(df: DataFrame, column: str, rules: Rules = SERVICE) -> DataFrame:
    """With ``__t``: the groups of tokens in ``column`` as (w, kind)."""
    r = rules
    start = text.unpack_contractions(F.col(column)) if r.contractions else F.col(column)
    df = df.withColumn("__t", tokenize(start))
    if r.elongated:
        df = df.withColumn("__t", F.transform("__t", lambda t: squashed(t, r)))
    df = df.withColumn("__t", F.array_join("__t", " "))
    if r.text:
        for parts, new in ((words.LAUGHS, "haha"), (words.SIGHS, "aduh"), (words.AGREED, "betul")):
            df = df.withColumn("__t", words.replace_any("__t", parts, new))
    df = df.withColumn("__t", F.array_join(tokenize("__t"), SEP))
    edge = f"(?<![^{SEP}])(?:{{}})(?=$|{SEP})"
    groups = "|".join([*(edge.format(p) for _, p in composites(r)), f"[^{SEP}]+"])
    return df.withColumn("__t", F.transform(F.regexp_extract_all("__t", F.lit(groups), F.lit(0)), lambda w: F.struct(w.alias("w"), kind_of(w, r).alias("kind"))))


def speak(df: DataFrame, column: str, rules: Rules = SERVICE, english: Column | bool = False, readings: str | None = None) -> DataFrame:
    """``column`` as it is spoken, in Malay or, per row, in English; null stays null. Steps of the plan keep each other's results, so nothing is computed twice.

    ``readings`` names a column with a map of what models make of words that no rule knows (see ``models``). A column ``__t`` of groups is taken as it is.
    """
    r = rules
    df = df.withColumn("__en", F.lit(english) if isinstance(english, bool) else F.coalesce(english, F.lit(False)))
    if "__t" not in df.columns:
        df = grouped(df, column, r)
    df = df.withColumn("__t", F.transform("__t", lambda g: F.struct(g["w"].alias("w"), g["kind"].alias("kind"), number_parts(g["w"], g["kind"], F.col("__en")).alias("n"))))
    # said inside the group: a column of all numbers, named once in a lambda, would be folded into it and computed anew for each group
    say = lambda v: F.when(v.isNotNull(), F.when(F.col("__en"), numbers.cardinal_en(v)).otherwise(numbers.cardinal_ms(v)))
    df = df.withColumn("__t", F.transform("__t", lambda g: F.struct(*(g[k].alias(k) for k in ("w", "kind", "n")), F.transform(F.array(g["n"]["a"], g["n"]["b"], g["n"]["c"]), say).alias("said"))))
    df = df.withColumn("__t", F.array_join(F.transform("__t", lambda g: in_words(g, F.col("__en"), r, F.col(readings) if readings else None)), " "))
    if r.date:  # dates that tokens only make together
        df = df.withColumn("__t", regex_map("__t", f"(?U){TOKENS['date']}", lambda m: F.when(F.col("__en"), dates.spoken_date(m, True)).otherwise(dates.spoken_date(m)), lambda t: t.rlike(r"(?U)\d")))
    return df.withColumn(column, text.fix_spacing(collapse(F.col("__t")))).drop("__t", "__en")
