"""DuckDB expressions for numerals, written with integer arithmetic and independent of the Spark functions."""

from __future__ import annotations

from tessitura.functions.numbers import DIGITS_MS, DIGITS_ZH, SMALL_EN, TENS_EN


def words(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def hundreds_ms(n: str) -> str:
    d, r = words(DIGITS_MS), f"(({n})%100)"
    return (
        f"concat_ws(' ', CASE WHEN ({n})//100=1 THEN 'seratus' WHEN ({n})//100>1 THEN {d}[({n})//100+1]||' ratus' END, "
        f"CASE WHEN {r}=0 THEN NULL WHEN {r}<10 THEN {d}[{r}+1] WHEN {r}=10 THEN 'sepuluh' WHEN {r}=11 THEN 'sebelas' "
        f"WHEN {r}<20 THEN {d}[{r}%10+1]||' belas' WHEN {r}%10=0 THEN {d}[{r}//10+1]||' puluh' ELSE {d}[{r}//10+1]||' puluh '||{d}[{r}%10+1] END)"
    )


def cardinal_ms(n: str) -> str:
    """Whole numbers below 10 ** 12."""
    parts = [f"CASE WHEN ({n})//{s}%1000>0 THEN {hundreds_ms(f'({n})//{s}%1000')}||' {w}' END" for s, w in ((10**9, "bilion"), (10**6, "juta"))]
    parts.append(f"CASE WHEN ({n})<1000000 AND ({n})//1000=1 THEN 'seribu' WHEN ({n})//1000%1000>0 THEN {hundreds_ms(f'({n})//1000%1000')}||' ribu' END")
    parts.append(f"CASE WHEN ({n})%1000>0 THEN {hundreds_ms(f'({n})%1000')} END")
    return f"CASE WHEN ({n})=0 THEN 'kosong' ELSE concat_ws(' ', {', '.join(parts)}) END"


def below_hundred_en(n: str, hyphen: str) -> str:
    return f"CASE WHEN ({n})<20 THEN {words(SMALL_EN)}[({n})+1] WHEN ({n})%10=0 THEN {words(TENS_EN)}[({n})//10+1] ELSE {words(TENS_EN)}[({n})//10+1]||'{hyphen}'||{words(SMALL_EN)}[({n})%10+1] END"


def hundreds_en(n: str, hyphen: str) -> str:
    low = below_hundred_en(f"({n})%100", hyphen)
    return f"CASE WHEN ({n})<100 THEN {low} WHEN ({n})%100=0 THEN {words(SMALL_EN)}[({n})//100+1]||' hundred' ELSE {words(SMALL_EN)}[({n})//100+1]||' hundred and '||{low} END"


def cardinal_en(n: str, hyphen: str = " ") -> str:
    """Whole numbers below 10 ** 9."""
    parts = [f"CASE WHEN ({n})//{s}%1000>0 THEN ({hundreds_en(f'({n})//{s}%1000', hyphen)})||' {w}' END" for s, w in ((10**6, "million"), (1000, "thousand"))]
    last = f"CASE WHEN ({n})%1000=0 THEN '' WHEN ({n})<1000 THEN {hundreds_en(f'({n})%1000', hyphen)} WHEN ({n})%1000<100 THEN ' and '||{below_hundred_en(f'({n})%1000', hyphen)} ELSE ', '||{hundreds_en(f'({n})%1000', hyphen)} END"
    return f"CASE WHEN ({n})=0 THEN 'zero' ELSE concat_ws(', ', {', '.join(parts)}) || ({last}) END"


def group_zh(n: str) -> str:
    d = words(DIGITS_ZH)
    return (
        f"(CASE WHEN ({n})>=1000 THEN {d}[({n})//1000+1]||'千' ELSE '' END)"
        f"||(CASE WHEN ({n})//100%10>0 THEN {d}[({n})//100%10+1]||'百' WHEN ({n})>=1000 AND ({n})%100>0 THEN '零' ELSE '' END)"
        f"||(CASE WHEN ({n})//10%10>0 THEN {d}[({n})//10%10+1]||'十' WHEN ({n})>=100 AND ({n})//100%10>0 AND ({n})%10>0 THEN '零' ELSE '' END)"
        f"||(CASE WHEN ({n})%10>0 THEN {d}[({n})%10+1] ELSE '' END)"
    )


def cardinal_zh(n: str) -> str:
    """Whole numbers below 10 ** 8."""
    low = f"CASE WHEN ({n})%10000=0 THEN '' WHEN ({n})>=10000 AND ({n})%10000<1000 THEN '零'||{group_zh(f'({n})%10000')} ELSE {group_zh(f'({n})%10000')} END"
    high = f"CASE WHEN ({n})>=10000 THEN {group_zh(f'({n})//10000')}||'万' ELSE '' END"
    return f"CASE WHEN ({n})=0 THEN '零' ELSE regexp_replace(({high})||({low}), '^一十', '十') END"


def digits(text: str, names: list[str], between: str = " ") -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace({text}, '[^0-9]', '', 'g'), ''), lambda d: {words(names)}[CAST(d AS INT)+1]), '{between}')"


def replaced(text: str, rules: list[tuple[str, str]]) -> str:
    """Nested replacements in order."""
    for pattern, new in rules:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), new.replace("'", "''"))
    return text
