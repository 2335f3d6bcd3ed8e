"""Numbers and words: Malay, English and Chinese numerals, digits, Roman numerals, fractions, money and units.

Whole numbers are read as strings of digits, so that they are exact up to 36 digits. Everything is a
composition of built-in functions over short arrays; what can't be read comes back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.rewriting import Text, col, let, lookup

# --- Fixed values: numerals ---------------------------------------------------------------------------
DIGITS_MS = ["kosong", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "lapan", "sembilan"]
SCALES_MS = ["", "ribu", "juta", "bilion", "trilion", "quadrillion", "quintillion", "sextillion", "septillion", "oktillion", "nonillion", "decillion"]
SMALL_EN = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)
TENS_EN = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES_EN = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion"]
ORDINALS_EN = {
    "one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
}
DIGITS_ZH = list("零一二三四五六七八九")
UNITS_ZH, BIG_ZH = ["", "十", "百", "千"], ["", "万", "亿", "万亿"]
ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]

# --- Fixed values: units ------------------------------------------------------------------------------
UNITS_MS = {"kg": "kilogram", "g": "gram", "l": "liter", "ml": "milliliter", "c": "celsius", "km": "kilometer", "m": "meter", "cm": "sentimeter", "kilo": "kilogram"}
UNITS_EN = UNITS_MS | {"c": "celcius", "cm": "centimeter"}
#: Prefixes of data sizes, and the words for small and capital b.
SIZE_PREFIXES, SIZE_WORDS_MS, SIZE_WORDS_EN = {"k": "kilo", "m": "mega", "g": "giga", "t": "tera"}, ("bit", "bait"), ("bits", "bytes")

# --- Fixed values: currencies as (marks before, words after, words for a hundredth, spoken unit, spoken hundredth, sign) ---
CURRENCIES = [
    (("$",), ("dollar",), ("cent",), "dollar", "cent", "$"),
    (("us",), ("usd",), (), "dollar", "cent", "$"),
    (("£",), ("pound",), ("penny",), "pound", "cent", "£"),
    (("€",), ("euro",), (), "euro", "cent", "€"),
    (("rm",), ("ringgit",), ("sen",), "ringgit", "sen", "RM"),
]
MULTIPLIERS = {"k": 1e3, "ribu": 1e3, "thousand": 1e3, "m": 1e6, "j": 1e6, "juta": 1e6, "million": 1e6, "b": 1e9, "bilion": 1e9, "billion": 1e9}


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def groups(digits: Column, size: int) -> Column:
    """The digits in groups of ``size`` as ints, the most significant first, without leading zeros."""
    padded = let(F.regexp_replace(digits, r"^0+(?=\d)", ""), lambda bare: F.lpad(bare, (F.ceil(F.length(bare) / F.lit(size)) * size).cast("int"), F.lit("0")))
    return let(padded, lambda p: F.transform(F.sequence(F.lit(0), (F.length(p) / size).cast("int") - 1), lambda i: F.substring(p, i * size + 1, F.lit(size)).cast("int")))


def spoken(parts: list[Column]) -> Column:
    """Parts joined by blanks; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*[F.nullif(p, F.lit("")) for p in parts]), lambda x: x.isNotNull()), " ")


def _below_thousand(say: Callable[[int], str], n: Column) -> Column:
    """What is said of a number below a thousand, from a table that the plan holds as one constant."""
    return F.get(F.split(F.lit("|".join(map(say, range(1000)))), r"\|"), n)


def _hundreds_ms(n: int) -> str:
    h, t, u = n // 100, n // 10 % 10, n % 10
    hundred = "" if h == 0 else "seratus" if h == 1 else f"{DIGITS_MS[h]} ratus"
    rest = {0: "", 10: "sepuluh", 11: "sebelas"}.get(n % 100)
    if rest is None:
        rest = DIGITS_MS[u] if t == 0 else f"{DIGITS_MS[u]} belas" if t == 1 else f"{DIGITS_MS[t]} puluh" + (f" {DIGITS_MS[u]}" if u else "")
    return f"{hundred} {rest}".strip()


def whole_ms(digits: Column) -> Column:
    """A string of at most 36 digits in Malay."""

    def say(parts: Column) -> Column:
        n = F.size(parts)

        def one(g: Column, i: Column) -> Column:
            scale = F.get(words(SCALES_MS), n - 1 - i)
            return F.when((n == 2) & (i == 0) & (g == 1), F.lit("seribu")).when(g > 0, F.concat_ws(" ", _below_thousand(_hundreds_ms, g), F.nullif(scale, F.lit(""))))

        return F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull()), " ")

    return let(let(groups(digits, 3), say), lambda said: F.when(said == "", "kosong").otherwise(said))


def _hundreds_en(n: int) -> str:
    h, r = n // 100, n % 100
    small = SMALL_EN[r] if r < 20 else TENS_EN[r // 10] + (f"-{SMALL_EN[r % 10]}" if r % 10 else "")
    return small if h == 0 else f"{SMALL_EN[h]} hundred" + (f" and {small}" if r else "")


def whole_en(digits: Column) -> Column:
    """A string of at most 36 digits in English, with hyphens; groups are set apart by commas as in ``one thousand, two hundred``."""

    def say(parts: Column) -> Column:
        return F.array_join(F.filter(F.transform(parts, lambda g, i: one(g, i, F.size(parts))), lambda x: x.isNotNull()), "")

    def one(g: Column, i: Column, n: Column) -> Column:
        scale = F.get(words(SCALES_EN), n - 1 - i)
        before = F.when(i == 0, "").when((i == n - 1) & (g < 100), " and ").otherwise(", ")
        joined = F.concat(before, _below_thousand(_hundreds_en, g))
        return F.when(g > 0, F.concat(joined, F.when(scale != "", F.concat(F.lit(" "), scale)).otherwise("")))

    return let(let(groups(digits, 3), say), lambda said: F.when(said == "", "zero").otherwise(F.regexp_replace(said, "^, ", "")))


def _cardinal(text: Text, whole, digits: list[str], point: str, minus: str) -> Column:
    """Sign, whole part and decimals of a number; what is no number comes back unchanged."""
    only = lambda d: F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x: F.get(words(digits), x.cast("int")))

    def say(bare: Column) -> Column:
        sizes, decimals = F.regexp_extract(bare, r"^-?(\d*)", 1), F.regexp_extract(bare, r"\.(\d+)$", 1)
        return F.concat(
            F.when(F.startswith(bare, F.lit("-")), minus).otherwise(""),
            whole(F.coalesce(F.nullif(sizes, F.lit("")), F.lit("0"))),
            let(decimals, lambda d: F.when(d != "", F.concat(F.lit(f" {point} "), F.array_join(only(d), " "))).otherwise("")),
        )

    def read(text: Column) -> Column:
        return let(F.regexp_replace(text, ",", ""), lambda bare: F.when(bare.rlike(r"^-?(\d{1,36}(\.\d+)?|\.\d+)$"), say(bare)).otherwise(text))

    return let(col(text).cast("string"), read)


def cardinal_ms(text: Text) -> Column:
    """``1234.5`` as ``seribu dua ratus tiga puluh empat perpuluhan lima``."""
    return _cardinal(text, whole_ms, DIGITS_MS, "perpuluhan", "negatif ")


def cardinal_en(text: Text) -> Column:
    """``1234.5`` as ``one thousand, two hundred and thirty four point five``: hyphens as blanks, "and" and commas stay."""
    return F.regexp_replace(_cardinal(text, whole_en, SMALL_EN, "point", "minus "), "(?<=[a-z])-(?=[a-z])", " ")


def ordinal_ms(text: Text) -> Column:
    """``pertama`` for one, else ``ke`` and the cardinal."""
    text = col(text).cast("string")
    return F.when(text.rlike(r"^0*1$"), "pertama").when(text.rlike(r"^\d{1,36}$"), F.concat(F.lit("ke"), whole_ms(text))).otherwise(text)


def ordinal_en(text: Text) -> Column:
    """``twenty-first``, hyphens kept."""

    def last_word(said: Column) -> Column:
        return let(F.regexp_extract(said, r"([a-z]+)$", 1), lambda last: F.concat(
            F.regexp_replace(said, r"[a-z]+$", ""),
            F.coalesce(
                F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDINALS_EN.items() for x in kv]), last),
                F.when(last.rlike("y$"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th"))),
            ),
        ))

    return let(col(text).cast("string"), lambda t: F.when(t.rlike(r"^\d{1,36}$"), let(whole_en(t), last_word)).otherwise(t))


def ordinal_number(text: Text) -> Column:
    return F.concat(F.lit("ke-"), col(text).cast("string"))


def currency_words(text: Text) -> Column:
    """A number in Malay words with the currency behind it."""
    return F.concat(cardinal_ms(text), F.lit(" ringgit"))


def digit_words(text: Text, english: bool = False) -> Column:
    """Every digit by itself, all else left out."""
    table = words(SMALL_EN[:10] if english else DIGITS_MS)
    only = F.filter(F.split(F.regexp_replace(col(text).cast("string"), "[^0-9]", ""), ""), lambda d: d != "")
    return F.array_join(F.transform(only, lambda d: F.get(table, d.cast("int"))), " ")


def roman_to_int(text: Text) -> Column:
    """A Roman numeral read from the left by the largest symbols; -1 if a character is none."""
    text = col(text)
    found = F.regexp_extract_all(text, F.lit("|".join(s for s, _ in sorted(ROMAN, key=lambda p: (-len(p[0]), -p[1])))), F.lit(0))
    value = F.create_map(*[F.lit(x) for kv in ROMAN for x in kv])
    # symbols are taken in descending order only: what comes after a smaller one is not reached
    read = F.aggregate(
        found,
        F.struct(F.lit(0).alias("sum"), F.lit(1 << 30).alias("last")),
        lambda acc, s: F.when(F.try_element_at(value, s) <= acc["last"], F.struct((acc["sum"] + F.try_element_at(value, s)).alias("sum"), F.try_element_at(value, s).alias("last"))).otherwise(F.struct(acc["sum"].alias("sum"), F.lit(0).alias("last"))),
        lambda acc: acc["sum"],
    )
    return F.when(text.rlike("^[MCDXLIV]*$"), read).otherwise(F.lit(-1))


def ordinal(text: Text, english: bool = False) -> Column:
    """Plain numbers, ``ke-3``, ``ke-IV`` and bare Roman numerals; else unchanged."""
    say = ordinal_en if english else ordinal_ms

    def read(text: Column, bare: Column) -> Column:
        stem = F.regexp_replace(bare, "^ke", "")
        plain = F.lit("") if english else F.when(F.startswith(bare, F.lit("ke")), "").otherwise("yang ")
        roman = let(roman_to_int(stem), lambda n: F.when(n > 0, F.concat(plain, say(n))).otherwise(text))
        return F.when(bare.rlike(r"^(ke)?\d{1,36}$"), say(stem)).when(bare.rlike("[VXILD]"), roman).otherwise(text)

    return let(col(text), lambda t: let(F.regexp_replace(t, "[,-]", ""), lambda bare: read(t, bare)))


def fraction(text: Text, english: bool = False) -> Column:
    """``3/4`` as ``tiga per empat``."""
    parts = F.split(col(text), "/")
    say, over = (cardinal_en, " over ") if english else (cardinal_ms, " per ")
    return F.when(col(text).rlike(r"^\d+/\d+$"), F.concat(say(F.get(parts, 0)), F.lit(over), say(F.get(parts, 1)))).otherwise(col(text))


def percent(text: Text, english: bool = False) -> Column:
    return F.concat((cardinal_en if english else cardinal_ms)(F.regexp_replace(col(text), "%", "")), F.lit(" percent" if english else " peratus"))


def times(text: Text, english: bool = False) -> Column:
    """``3x`` as ``tiga kali``."""
    return F.concat((cardinal_en if english else cardinal_ms)(F.regexp_replace(col(text), "[xX]$", "")), F.lit(" times" if english else " kali"))


def size_units(english: bool) -> dict[str, str]:
    """Data sizes by their spelling: a small b is a bit, a capital one a byte."""
    bit, byte = SIZE_WORDS_EN if english else SIZE_WORDS_MS
    return {p + b: prefix + (bit if b == "b" else byte) for k, prefix in SIZE_PREFIXES.items() for p in (k, k.upper()) for b in "bB"}


def unit_words(text: Text, english: bool = False) -> Column:
    """``5kg`` as ``lima kilogram``; a unit that is not known stays as it is."""
    text = col(text)
    number, unit = F.regexp_replace(text, "[^0-9.]", ""), F.regexp_replace(text, "[0-9. ]", "")
    return F.when(number.rlike(r"^\d{1,36}(\.\d+)?$"), F.concat((cardinal_en if english else cardinal_ms)(number), F.lit(" "), unit_name(unit, english))).otherwise(text)


def unit_name(unit: Column, english: bool = False) -> Column:
    """A unit in full; one that is not known stays as it is."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (UNITS_EN if english else UNITS_MS).items() for x in kv]), F.lower(unit)), unit)
    return lookup(named, size_units(english))


def plain_number(x: Column) -> Column:
    """A double as the shortest text of its value to five decimals, without exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,5)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def multiplied(number: Column, suffix: Column) -> Column:
    """Number times the factor of its suffix; within 1e-5 of the next whole number, that number."""
    known = lambda s: F.try_element_at(F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv]), s)
    # bn, mn, bil and the like go by their first letter
    factor = let(F.lower(suffix), lambda s: F.coalesce(known(s), F.when(s.rlike("^[kmbj](n|i(l|lion|llion)?)$"), known(F.left(s, F.lit(1)))), F.lit(1.0)))
    value = F.regexp_replace(number, "[,']", "").cast("double") * factor
    return F.when(1 - value % 1 < 1e-5, F.ceil(value).cast("double")).otherwise(value)


def shortform(text: Text) -> Column:
    """``1.5k`` as ``1500``."""
    text = col(text)
    number, suffix = (F.regexp_extract(text, r"^(\d+(?:[.,']\d+)?)\s*([A-Za-z]+)$", i) for i in (1, 2))
    return F.when(number != "", plain_number(multiplied(number, suffix))).otherwise(text)


def amount(text: Text) -> Column:
    """(shown, unit, cent, sign) of an amount of money, the multiplier worked in; null where there is no currency."""
    nothing = F.lit(None).cast("struct<shown:string,unit:string,cent:string,sign:string>")

    def parts(core: Column, in_cents: Column, unit: str, cent: str, sign: str) -> Column:
        number, suffix = F.regexp_extract(core, r"^(\d+(?:[.,']\d+)?)", 1), F.trim(F.regexp_extract(core, r"^\d+(?:[.,']\d+)?\s*([a-z]*)", 1))
        scaled = plain_number(multiplied(number, suffix) / F.when(in_cents, 100.0).otherwise(1.0))
        shown = F.when(in_cents | (suffix != ""), scaled).otherwise(F.regexp_replace(number, ",", ""))
        return F.when(number != "", F.struct(shown.alias("shown"), F.lit(unit).alias("unit"), F.lit(cent).alias("cent"), F.lit(sign).alias("sign"))).otherwise(nothing)

    def read(low: Column) -> Column:
        out = nothing
        for before, after, cents, unit, cent, sign in reversed(CURRENCIES):
            marks, ends = "|".join(m.replace("$", r"\$") for m in before), "|".join([*after, *cents])
            in_cents = ~low.rlike(f"^({marks})") & low.rlike(f"({'|'.join(cents)})$") if cents else F.lit(False)
            core = F.trim(F.regexp_replace(low, f"{ends}|{marks}", ""))
            out = F.when(low.rlike(f"^({marks})|({ends})$"), _bound(core, parts, in_cents, unit, cent, sign)).otherwise(out)
        return out

    return let(F.lower(col(text)), read)


def money(text: Text, english: bool = False) -> Column:
    """(spoken, canonical) of an amount; the canonical form is null where there is no currency.

    One decimal is tens of hundredths, hundredths are spoken even if they are zero, and a zero whole part is not.
    """
    say, zero = (cardinal_en, "zero") if english else (cardinal_ms, "kosong")

    def speak(a: Column) -> Column:
        whole, part = F.regexp_extract(a["shown"], r"^(\d+)", 1), F.regexp_extract(a["shown"], r"\.(\d+)$", 1)
        part = F.when(F.length(part) == 1, F.concat(part, F.lit("0"))).otherwise(part)
        units = let(say(whole), lambda s: F.when(s != zero, F.concat(s, F.lit(" "), a["unit"])))
        return F.struct(spoken([units, let(part, lambda p: F.when(p != "", F.concat(say(p), F.lit(" "), a["cent"])))]).alias("spoken"), F.concat(a["sign"], a["shown"]).alias("canonical"))

    unread = F.struct(col(text).alias("spoken"), F.lit(None).cast("string").alias("canonical"))
    return let(amount(text), lambda a: F.when(a.isNotNull(), speak(a)).otherwise(unread))


def _bound(core: Column, parts, *rest) -> Column:
    return let(core, lambda c: parts(c, *rest))


def cardinal_zh(text: Text) -> Column:
    """A number in Chinese: groups of four, zeros where places are skipped, a leading ten without its one."""
    digit = lambda i: F.get(words(DIGITS_ZH), i)

    def group(g: Column) -> Column:
        d = [(g / 1000).cast("int"), (g / 100).cast("int") % 10, (g / 10).cast("int") % 10, g % 10]
        out, before = [], F.lit(False)
        for i, x in enumerate(d):
            gap = before & (d[i - 1] == 0) if i else F.lit(False)
            out.append(F.when(x > 0, F.concat(F.when(gap, DIGITS_ZH[0]).otherwise(""), digit(x), F.lit(UNITS_ZH[3 - i]))).otherwise(""))
            before = before | (x > 0)
        return F.concat(*out)

    def whole(parts: Column) -> Column:
        zero = lambda acc, x: F.when((acc["out"] != "") & (acc["gap"] | (x["g"] < 1000)), DIGITS_ZH[0]).otherwise("")
        return F.aggregate(
            F.transform(parts, lambda g, i: F.struct(g.alias("g"), F.get(words(BIG_ZH), F.size(parts) - 1 - i).alias("big"))),
            F.struct(F.lit("").alias("out"), F.lit(False).alias("gap")),
            lambda acc, x: F.when(x["g"] == 0, F.struct(acc["out"].alias("out"), (acc["out"] != "").alias("gap"))).otherwise(
                F.struct(F.concat(acc["out"], zero(acc, x), group(x["g"]), x["big"]).alias("out"), F.lit(False).alias("gap"))
            ),
            lambda acc: F.when(acc["out"] == "", DIGITS_ZH[0]).otherwise(F.regexp_replace(acc["out"], "^一十", "十")),
        )

    def say(bare: Column) -> Column:
        sizes, decimals = F.regexp_extract(bare, r"^-?(\d*)", 1), F.regexp_extract(bare, r"\.(\d+)$", 1)
        return F.concat(
            F.when(F.startswith(bare, F.lit("-")), "负").otherwise(""),
            let(groups(F.coalesce(F.nullif(sizes, F.lit("")), F.lit("0")), 4), whole),
            let(decimals, lambda d: F.when(d != "", F.concat(F.lit("点"), digits_zh(d))).otherwise("")),
        )

    def read(text: Column) -> Column:
        return let(F.regexp_replace(text, "[, ]", ""), lambda bare: F.when(bare.rlike(r"^-?(\d{1,16}(\.\d+)?|\.\d+)$"), say(bare)).otherwise(text))

    return let(col(text).cast("string"), read)


def digits_zh(text: Text) -> Column:
    """Every digit in Chinese, all else left out."""
    return F.translate(F.regexp_replace(col(text).cast("string"), "[^0-9]", ""), "0123456789", "".join(DIGITS_ZH))


def words_to_number(text: Text) -> Column:
    """A Malay numeral below 10 ** 15 as a number; null if a word is none or scales do not fall."""
    tokens = F.split(F.regexp_replace(F.regexp_replace(F.trim(F.lower(col(text))), r"\bse(ratus|puluh|belas|ribu)\b", "satu $1"), r"\s+", " "), " ")
    value = F.create_map(*[F.lit(x) for kv in {w: float(i) for i, w in enumerate(DIGITS_MS)}.items() for x in kv])
    scale = F.create_map(*[F.lit(x) for kv in {"ribu": 1e3, "juta": 1e6, "bilion": 1e9, "trilion": 1e12}.items() for x in kv])

    def step(acc: Column, w: Column) -> Column:
        v, s = F.try_element_at(value, w), F.try_element_at(scale, w)
        keep = lambda total, hundred, unit, last, ok: F.struct(total.alias("total"), hundred.alias("hundred"), unit.alias("unit"), last.alias("last"), ok.alias("ok"))
        zero = F.lit(0.0)
        return (
            F.when(v.isNotNull(), keep(acc["total"], acc["hundred"], v, acc["last"], acc["ok"] & (acc["unit"] == 0)))
            .when(w == "ratus", keep(acc["total"], acc["unit"] * 100, zero, acc["last"], acc["ok"] & (acc["unit"] > 0) & (acc["hundred"] == 0)))
            .when(w == "puluh", keep(acc["total"], acc["hundred"] + acc["unit"] * 10, zero, acc["last"], acc["ok"] & (acc["unit"] > 0)))
            .when(w == "belas", keep(acc["total"], acc["hundred"] + acc["unit"] + 10, zero, acc["last"], acc["ok"] & (acc["unit"] > 0)))
            .when(s.isNotNull(), keep(acc["total"] + (acc["hundred"] + acc["unit"]) * s, zero, zero, s, acc["ok"] & (s < acc["last"]) & (acc["hundred"] + acc["unit"] > 0)))
            .otherwise(keep(acc["total"], acc["hundred"], acc["unit"], acc["last"], F.lit(False)))
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("hundred"), F.lit(0.0).alias("unit"), F.lit(1e18).alias("last"), F.lit(True).alias("ok"))
    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["ok"], (acc["total"] + acc["hundred"] + acc["unit"]).cast("long")))
