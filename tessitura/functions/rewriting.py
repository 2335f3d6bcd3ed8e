"""Building blocks for string rewriting: ordered folds, computed replacements and white space."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; without it, nested functions would multiply the plan."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(text: Text, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order; later rules see what earlier ones made."""
    out = col(text)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def regex_map(text: Text, pattern: str, make: Callable[[Column], Column], only: Callable[[Column], Column] | None = None) -> Column:
    """Replace every match by ``make(match)``. The pattern must not match the empty string.

    The text is split at the matches, and the gaps are zipped with what is made of the matches: all inside
    one expression, whatever ``make`` builds. A column's name is used twice, so that a step of a plan
    is not folded into the step before. ``only`` is a cheap test that every text with a match passes: others are not searched.
    """

    def join(t: Column) -> Column:
        made = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), make)
        out = F.array_join(F.zip_with(F.split(t, pattern, -1), made, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
        return out if only is None else F.when(only(t), out).otherwise(t)

    return join(F.col(text)) if isinstance(text, str) else let(text, join)


def strip(text: Text) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def collapse(text: Text) -> Column:
    """Line feeds as blanks, runs of blanks as one, nothing at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(col(text), "\n", " "), " +", " "))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The table's value for a key, else ``default``, else the key itself."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key if default is None else default)


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def title(text: Column) -> Column:
    """Every run of letters with a capital first letter, unlike ``initcap`` also after an apostrophe or a hyphen."""
    return regex_map(text, r"(?U)\p{L}+", first_upper)
