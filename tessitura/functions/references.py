"""Character references of HTML, read as a browser reads them in text."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.rewriting import Text, col, let, regex_map

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What numbers from 128 to 159 stand for: characters of Windows' western code page, or themselves where it has none.
WESTERN = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
#: Names that count without a semicolon too, even at the start of a longer word.
BARE = {n: c for n, c in html.entities.html5.items() if not n.endswith(";")}


def table(pairs: dict[str, str]) -> Column:
    """A map as one literal, which is made once when the plan is."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def character(point: Column) -> Column:
    """The character with a number."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def numbered(reference: Column) -> Column:
    """The character of ``&#123;`` or ``&#x7b;``: the replacement character for numbers that none has, nothing for those that are no text."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(reference.rlike("^&#[xX]"), 16).otherwise(10)
    number = F.when(F.length(digits) > 8, 1 << 32).otherwise(F.coalesce(F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0)))
    western = F.array(*(F.lit(WESTERN[n]) for n in sorted(WESTERN)))

    def read(n: Column) -> Column:
        no_text = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
            .when(n.between(0x80, 0x9F), F.get(western, (n - 0x80).cast("int")))
            .when(no_text, "")
            .otherwise(character(n))
        )

    return let(number, read)


def named(reference: Column) -> Column:
    """The characters of ``&name;``, of a name without its semicolon if it has leave, and of the longest such name that a word starts with, before the rest of the word."""
    name = F.substring(reference, 2, 40)

    def read(n: Column) -> Column:
        lengths = F.sequence(F.lit(6), F.lit(2), F.lit(-1))  # no name without a semicolon is longer than six letters
        start = F.get(F.filter(lengths, lambda i: (i < F.length(n)) & F.try_element_at(table(BARE), F.left(n, i)).isNotNull()), 0)
        return F.coalesce(F.try_element_at(table(html.entities.html5), n), F.concat(F.try_element_at(table(BARE), F.left(n, start)), F.substring(n, start + 1, F.lit(40))), reference)

    return let(name, read)


def unescape_html(text: Text) -> Column:
    """All character references of a text replaced in one pass, so that none is made of another. Texts without an ampersand are passed on."""
    t = col(text)
    return F.when(F.contains(t, F.lit("&")), regex_map(t, REFERENCE, lambda m: F.when(F.startswith(m, F.lit("&#")), numbered(m)).otherwise(named(m)))).otherwise(t)
