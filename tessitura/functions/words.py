"""Informal words: laughter and sighs, drawn-out letters, repeats, affixes, compounds and titles."""

from __future__ import annotations

from itertools import combinations, groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.numbers import SMALL_EN, cardinal_en, cardinal_ms, words
from tessitura.functions.rewriting import Text, col, fold, let, lookup, regex_map
from tessitura.functions.text import recase
from tessitura.operators.tokens import TOKENS

# --- Fixed values: marks, laughter, sighs, agreement ---------------------------------------------------
PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"
IGNORED = ["ringgit", "sen", "hmm", "hhmm", "hmmm"]
LAUGHS = ["huhu", "hahha", "gagaga", "sksk", "haha", "wkwk", "hshs", "uwu", "hihi", "hoho", "huehue", "ksks", "hehe", "hewhew", "jahagaha", "wkawka", "keke", "ahksk", "ahakss", "kiki"]
SIGHS = ["argh", "hais", "adoi", "aduh", "haih", "hoih"]
AGREED = ["haah", "aah", "ha'ah", "haahh", "hhaahh"]

# --- Fixed values: single letters and titles ------------------------------------------------------------
SOUNDS = {"x": "tidak", "y": "kenapa", "n": "dan", "g": "pergi", "s": "seperti", "d": "di", "k": "ok", "u": "awak", "t": "nanti", "p": "pergi", "wai": "kenapa", "i": "saya"}
TITLES = {"dr": "Doktor", "yb": "Yang Berhormat", "hj": "Haji", "ybm": "Yang Berhormat Mulia", "tyt": "Tuan Yang Terutama", "yab": "Yang Berhormat", "yabhg": "Yang Amat Berbahagia", "ybhg": "Yang Berbahagia", "miss": "Cik", "ydh": "Yang Dihormati"}

# --- Fixed values: endings that stand for others -----------------------------------------------------------
PARTICLES = ["lah", "la", "ler", "lh"]
WHOLE = ["adalah", "allah"]
ENDINGS = {
    "kn": "kan", "knn": "kan", "kknn": "kan", "kkn": "kan", "kan": "kan", "kann": "kan", "kkann": "kan", "kaan": "kan", "kaann": "kan",
    "kah": "kah", "kahh": "kah", "lah": "lah", "lahh": "lah", "loh": "lah", "lohh": "lah", "lh": "lah", "lhh": "lah", "ler": "lah",
    "tah": "tah", "tahh": "tah", "nya": "nya", "nyaa": "nya", "nye": "nya", "nyee": "nya", "nyo": "nya", "nyoo": "nya", "ny": "nya",
    "an": "an", "ann": "an", "wan": "wan", "wann": "wan", "wati": "wati", "watii": "wati", "ita": "ita", "itaa": "ita",
}
#: Beginnings that stand for others, before a stem.
PREFIXES = {
    "bel": "bel", "se": "se", "see": "se", "ter": "ter", "terr": "ter", "men": "men", "menn": "men", "meng": "meng", "mengg": "meng", "mem": "mem", "mm": "mem", "memper": "memper",
    "di": "di", "ddi": "di", "pe": "pe", "ppe": "pe", "ppee": "pe", "me": "me", "mme": "mme", "ke": "ke", "kee": "ke", "ber": "ber", "berr": "ber", "pen": "pen", "penn": "pen", "per": "per", "perr": "perr",
}


def repeated(word: Column, times: Column, root: Column | None = None) -> Column:
    """A word as often as asked, with hyphens. Words that start with ``se`` or ``ter`` are followed by their ``root`` instead, where one is known."""
    again = word if root is None else F.when(word.rlike("^(?:se|ter)"), F.coalesce(root, word)).otherwise(word)
    return F.when(times > 1, F.concat_ws("-", word, F.array_repeat(again, times - 1))).otherwise(word)


def is_number(token: Text) -> Column:
    """Digits, with decimals or without."""
    return col(token).rlike(r"(?U)^\d+(\.\d+)?$")


def is_punctuation(token: Text) -> Column:
    """A piece of the string of marks; the hyphen is none of them."""
    return F.instr(F.lit(PUNCTUATION), col(token)) > 0


def is_ignored(token: Text) -> Column:
    return F.lower(col(token)).isin(IGNORED)


def sounds_like(token: Text, parts: list[str]) -> Column:
    """Whether a word has one of the parts in it; tags, names and words in capitals pass too."""
    t = col(token)
    special = t.rlike("^[#@]") | ((F.upper(t) == t) & (F.lower(t) != t))
    return special | F.exists(words(parts), lambda p: F.contains(F.lower(t), p))


def variants(word: str) -> list[str]:
    """A word with any of its letters doubled: a table made once, not per row."""
    out = {word, "".join(c * 2 for c in word)}
    for n in range(1, len(word) + 1):
        for chosen in combinations(sorted(set(word)), min(n, len(set(word)))):
            doubled = "".join(c * 2 if c in chosen else c for c in word)
            out.add("".join("".join(run)[:2] for _, run in groupby(doubled)))
    return sorted(out)


def replace_any(text: Text, parts: list[str], new: str) -> Column:
    """Addresses, tags, amounts and dates that have one of the parts become ``new`` in their own case; ordinary words stay."""
    kinds = "|".join(TOKENS[k] for k in ("email", "url", "hashtag", "phone", "money", "date"))

    def word(w: Column) -> Column:
        hit = (w.rlike(f"(?U){kinds}") | is_number(w)) & F.exists(words(parts), lambda p: F.contains(F.lower(w), p))
        return F.when(hit, recase(F.lit(new), w)).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""), word), " ")


def squash_words(text: Text) -> Column:
    """Runs of a letter cut to two in words that are no number, address or amount."""
    guarded = "|".join(TOKENS[k] for k in ("url", "money", "number"))
    squash = lambda w: F.when(w.rlike(f"(?U){guarded}"), w).otherwise(F.regexp_replace(w, r"(.)\1{2,}", "$1$1"))
    return F.array_join(F.transform(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""), squash), " ")


def space_numbers(text: Text, english: bool = False) -> Column:
    """Letters and digits set apart, and numbers read digit by digit."""
    digit = words(SMALL_EN[:10]) if english else words(["kosong", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "lapan", "sembilan"])
    parts = F.filter(F.split(F.regexp_replace(col(text), "([A-Za-z]+)", " $1 "), r"\s+"), lambda w: w != "")
    spell = lambda w: F.array_join(F.transform(F.filter(F.split(w, ""), lambda d: d != ""), lambda d: F.get(digit, d.cast("int"))), " ")
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^\d+$"), spell(w)).otherwise(w)), " ")


def all_cardinals(text: Text, english: bool = False) -> Column:
    """Hyphens as blanks, and every number in words."""
    said = regex_map(F.replace(col(text), F.lit("-"), F.lit(" ")), r"\d+", lambda m: F.concat(F.lit(" "), (cardinal_en if english else cardinal_ms)(m), F.lit(" ")))
    return F.trim(F.regexp_replace(said, " +", " "))


def spoken_title(word: Text) -> Column:
    """Titles written out if their first letter is a capital."""
    w = col(word)
    return F.when(w.rlike(r"^\p{Lu}"), lookup(F.lower(w), TITLES, w)).otherwise(w)


def spoken_letter(word: Text) -> Column:
    return lookup(F.lower(col(word)), SOUNDS, col(word))


def negated(word: Text) -> Column:
    """``xnak`` as ``tak nak``; a final e as a."""
    return fold(word, [(r"^[xX](?=[a-z]{2,})", "tak "), (r"(?<=[bcdfghjklmnpqrstvwxyz])e$", "a")])


def without_ending(word: Text) -> Column:
    """(stem, ending): particles first, else the ending with the longest standard form; a digit at the end stays with the stem."""
    def cut(w: Column) -> Column:
        digit, bare = F.regexp_extract(w, r"(\d?)$", 1), F.regexp_replace(w, r"\d$", "")
        out = F.struct(w.alias("stem"), F.lit("").alias("ending"))
        for ending, standard in sorted(ENDINGS.items(), key=lambda e: (len(e[1]), -list(ENDINGS).index(e[0]))):
            out = F.when(F.endswith(bare, F.lit(ending)), F.struct(F.concat(F.regexp_replace(bare, f"{ending}$", ""), digit).alias("stem"), F.lit(standard).alias("ending"))).otherwise(out)
        for particle in reversed(PARTICLES):
            out = F.when(F.endswith(bare, F.lit(particle)), F.struct(F.concat(F.regexp_replace(bare, f"{particle}$", ""), digit).alias("stem"), F.lit("lah").alias("ending"))).otherwise(out)
        whole = F.lit(False)
        for w_ in WHOLE:
            whole = whole | F.endswith(w, F.lit(w_))
        return F.when(whole, F.struct(w.alias("stem"), F.lit("").alias("ending"))).otherwise(out)

    return let(col(word), cut)


def without_affixes(word: Text, stem: Text) -> Column:
    """(stem, ending, root) of a word whose stem a stemmer has told: a prefix in standard form stays with the stem, a digit at the end too; ``root`` has neither.

    ``stem`` is that of the word without its digit; a null, empty or foreign stem leaves the word whole.
    """

    def cut(x: Column) -> Column:
        w, s = x["w"], x["s"]
        digit, bare = F.regexp_extract(w, r"(\d?)$", 1), F.regexp_replace(w, r"\d$", "")
        whole = (F.coalesce(s, F.lit("")) == "") | (s == bare) | F.array_contains(F.transform(words(WHOLE), lambda p: F.endswith(w, p)), True)

        def parts(p: Column) -> Column:
            before, after = F.left(bare, F.length(F.get(p, 0))), F.right(bare, F.length(F.get(p, F.size(p) - 1)))
            middle = F.substring(bare, F.length(before) + 1, F.length(bare) - F.length(before) - F.length(after))
            ending = lookup(after, ENDINGS)
            return F.when(F.size(p) > 1, F.struct(F.concat(lookup(before, PREFIXES), middle, digit).alias("stem"), F.when(ending.isin(PARTICLES), "lah").otherwise(ending).alias("ending"), middle.alias("root")))

        split = let(F.split(F.lower(bare), F.concat(F.lit("\\Q"), F.replace(F.lower(s), F.lit("\\E"), F.lit("")), F.lit("\\E")), -1), parts)
        none = F.struct(w.alias("stem"), F.lit("").alias("ending"), bare.alias("root"))
        return F.when(whole, none).otherwise(F.coalesce(split, none))

    return let(F.struct(col(word).alias("w"), col(stem).alias("s")), cut)


def replace_phrases(text: Text, table: dict[str, str]) -> Column:
    """Phrases followed by a blank or the end, in any case, in the order of the table; ``table`` is a dictionary of the caller's."""
    return fold(text, [(rf"(?iU)\b\Q{k}\E(?= |$)", v) for k, v in table.items()])


def multireplace(text: Text, table: dict[str, str]) -> Column:
    """All keys in one pass, longest first: what was put in is not replaced again."""
    keys = "|".join(rf"\Q{k}\E" for k in sorted(table, key=len, reverse=True))
    return regex_map(col(text), keys, lambda m: lookup(m, table))
