"""Personal data by candidate gradient boosting, in DataFrame functions only.

*Generators* of high recall propose spans that may overlap: the four base patterns, loose runs of digits, and loosely
written addresses of mail and hosts. Base matches that pass their checks are kept as they are. Every other
candidate gets features of its format and its context, boosted trees score it, and those above a calibrated
threshold are added.

The trees learn from the corpus itself. Examples are its checked base spans where they stand, as they are and with their form damaged as
people write it (``(at)``, blanks around dots, other marks between digits, no country code), so that no pattern of the base finds them.
Counterexamples are the other candidates that no base span overlaps, and the base matches that fail their checks (numbers of no card, addresses of no host), as they are and damaged in the
same ways, so that what tells examples apart is not the damage. Both are told with and without their context. Candidates of which nothing is known weigh less the more examples their cell has (``weighed``). All features are yes or no, so the candidates of a corpus, however many, fall
into at most ``2 ** len(FEATURES)`` cells, and the counts of the cells hold all that boosting needs. Spark counts the cells over all
documents; the driver boosts over the counts; the trees become CASE expressions. Each family of candidates has its threshold: the
smallest score at which the held-out fold has the asked share of examples, in the family itself if it has enough held-out examples to show that share, else in all families together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import staged, table

#: Stands around matches while a text is taken apart; where a text has it, it is read as another character of the same length.
MARK, INSTEAD = "\ue000", "\ue001"
#: Prefix sums over the pieces of a text are made in blocks of this many.
BLOCK = 256
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with possessive loops and starts only where an earlier one could not succeed, so that they
#: match what their plain forms match in linear time.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "digits": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "host": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9])",
    "mail": rf"(?:\G|(?<!{LOCAL})){LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
}
CONTEXT = r"(?i)(?:mail|phone|tel|mobil|fax|call|contact|kontakt|card|karte|carte|tarjeta|visa|account|konto|compte|cuenta|\bip\b|address|adresse|host)[^\n]*$"
#: Families come first: their features tell which threshold holds.
FEATURES = ("mail", "host", "digits_9", "digits_12", "digits_16", "digits_20", "luhn", "bytes", "plus", "paren", "dot", "dash", "blank", "blanks", "groups_4", "context", "attached")
FAMILIES = ("mail", "host", "digits")
ROUNDS, RATE, PRECISION = 40, 0.3, 0.95
#: Least score of any threshold: many clear examples must not pay for candidates that are likelier none.
LIKELY = 0.5
#: Base patterns as they are written to escape a pattern, in turn by a hash of the match: (what, by what) in order.
DAMAGED = {
    "email": [[("@", " (at) "), (r"\.", " (dot) ")], [("@", "(at)")], [("@", " [at] "), (r"\.", " [dot] ")], [("@", " @ ")], [("@", "[at]")]],
    "ip": [[(r"\.", " . ")], [(r"\.", ". ")], [(r"\.", "(dot)")], [(r"\.", "[dot]")]],
    "card": [[("[^0-9]", ""), ("(....)(?=.)", "$1.")], [("[^0-9]", ""), ("(....)(?=.)", "$1  ")], [("[^0-9]", ""), ("(....)(?=.)", "$1--")]],
    "phone": [[(r"^\+", "")], [(r"^\+[0-9]{1,3}[\x20.-]+", "")], [(r"^\+", ""), (r"[\x20()-]+", ".")], [(r"^\+", "00")]],
}


def pieces_of(df: DataFrame, name: str, text: str, pattern: str, only: Column) -> DataFrame:
    """Add ``name``: an array of (start, end, found, before, after) for all matches, in code points, end exclusive."""
    p, lens, blocks, starts = (f"__{name}_{x}" for x in ("pieces", "lens", "blocks", "starts"))
    split = F.split(F.regexp_replace(F.col(text), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    df = df.withColumn(p, F.when(only, split))
    df = df.withColumn(lens, F.when(F.size(p) > 1, F.transform(p, F.char_length)))
    last = F.floor((F.size(lens) - 1) / F.lit(BLOCK)).cast("int")
    df = df.withColumn(blocks, F.when(F.size(lens) > 1, F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))))
    df = df.withColumn(starts, F.when(F.size(blocks) > 0, F.transform(blocks, lambda x, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda a, y: a + y))))

    def span(i: Column) -> Column:
        block = F.floor(i / F.lit(BLOCK)).cast("int")
        start = F.get(starts, block) + F.aggregate(F.slice(lens, block * BLOCK + 1, i - block * BLOCK), F.lit(0), lambda a, x: a + x)
        return F.struct(start.alias("start"), (start + F.get(lens, i)).alias("end"), F.get(p, i).alias("found"), F.right(F.get(p, i - 1), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"))

    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    found = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), span))
    return df.withColumn(name, F.coalesce(found, none)).drop(p, lens, blocks, starts)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def value(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        plain = lambda p: F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))
        return F.forall(F.split(found, r"\."), lambda p: F.when(F.length(plain(p)) <= 4, plain(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits(found)).between(12, 19), luhn(digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def features(c: Column, family: str) -> Column:
    """The cell of a candidate: bit i is feature i of FEATURES."""
    found = c["found"]
    parts = F.split(F.regexp_replace(found, r"^[^0-9]+|[^0-9]+$", ""), r"[^0-9]+")
    n = F.length(digits(found))
    yes = {
        **{k: F.lit(family == k) for k in FAMILIES[:2]},
        **{f"digits_{k}": n >= k for k in (9, 12, 16, 20)},
        "luhn": F.when(n.between(12, 19), luhn(digits(found))).otherwise(F.lit(False)),
        "bytes": F.forall(parts, lambda p: F.length(p).between(1, 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)),
        "plus": F.startswith(found, F.lit("+")) | F.startswith(found, F.lit("00")),
        **{k: F.contains(found, F.lit(x)) for k, x in (("paren", "("), ("dot", "."), ("dash", "-"), ("blank", " "), ("blanks", "  "))},
        "groups_4": F.size(F.split(found, r"[^0-9A-Za-z]+")) >= 4,
        "context": F.coalesce(c["before"].rlike(CONTEXT), F.lit(False)),
        "attached": F.coalesce(c["before"].rlike("[A-Za-z0-9_]$"), F.lit(False)) | F.coalesce(c["after"].rlike("^[A-Za-z0-9_]"), F.lit(False)),
    }
    if family == "mail":  # digits tell nothing about names
        yes |= {k: F.lit(False) for k in ("luhn", "bytes", *(f"digits_{n}" for n in (9, 12, 16, 20)))}
    out = F.lit(0)
    for i, name in enumerate(FEATURES):
        out = out + F.when(yes[name], 1 << i).otherwise(0)
    return out


def damaged(kind: str, found: Column) -> Column:
    """A base match as it is written to escape its pattern."""
    ways = DAMAGED[kind]
    turn = F.pmod(F.xxhash64(found), F.lit(len(ways)))
    out = found
    for i, rules in enumerate(ways):
        made = found
        for what, new in rules:
            made = F.regexp_replace(made, what, new)
        out = F.when(turn == i, made).otherwise(out)
    return out


def family_of(cell: int) -> str:
    return next((k for i, k in enumerate(FAMILIES[:2]) if cell >> i & 1), FAMILIES[-1])


@dataclass(frozen=True)
class Model:
    """Boosted trees of depth two: (feature, feature if yes, feature if no, values yes-yes, yes-no, no-yes, no-no)."""

    bias: float
    trees: tuple[tuple[int, int, int, float, float, float, float], ...]
    thresholds: dict[str, float]

    def raw(self, cell: int) -> float:
        return self.bias + sum((yy if cell >> a & 1 else yn) if cell >> f & 1 else (ny if cell >> b & 1 else nn) for f, a, b, yy, yn, ny, nn in self.trees)

    def score(self, cell: Column) -> Column:
        """The model as an expression over a cell."""
        has = lambda i: cell.bitwiseAND(F.lit(1 << i)) != 0
        out = F.lit(self.bias)
        for f, a, b, yy, yn, ny, nn in self.trees:
            out = out + F.when(has(f), F.when(has(a), yy).otherwise(yn)).otherwise(F.when(has(b), ny).otherwise(nn))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))

    def selects(self, cell: Column) -> Column:
        """Whether a cell's score reaches its family's threshold."""
        least = F.lit(self.thresholds[FAMILIES[-1]])
        for i, k in enumerate(FAMILIES[:2]):
            least = F.when(cell.bitwiseAND(F.lit(1 << i)) != 0, self.thresholds[k]).otherwise(least)
        return self.score(cell) >= least


def boost(cells: dict[int, tuple[float, float]], held: dict[int, tuple[float, float]]) -> Model:
    """Gradient boosting of the logistic loss over cell counts (counterexamples, examples), and the threshold from the held-out counts."""
    no, yes = (sum(v[i] for v in cells.values()) for i in (0, 1))
    bias = math.log((yes + 0.5) / (no + 0.5))
    raw = dict.fromkeys(cells, bias)
    trees = []
    for _ in range(ROUNDS if yes and no else 0):
        slope = {}
        for c, (n, y) in cells.items():
            p = 1 / (1 + math.exp(-raw[c]))
            slope[c] = (y - (n + y) * p, (n + y) * p * (1 - p))

        def part(f: int, side: int, of: list[int]) -> tuple[list[int], float, float]:
            own = [c for c in of if c >> f & 1 == side]
            g, h = sum(slope[c][0] for c in own), sum(slope[c][1] for c in own) + 1.0
            return own, g * g / h, RATE * g / h

        def best(of: list[int]) -> tuple[float, int]:
            return max((part(f, 1, of)[1] + part(f, 0, of)[1], -f) for f in range(len(FEATURES)))

        gains = []
        for f in range(len(FEATURES)):
            y, n = part(f, 1, list(cells))[0], part(f, 0, list(cells))[0]
            (gy, a), (gn, b) = best(y), best(n)
            gains.append((gy + gn, -f, -a, -b, y, n))
        _, f, a, b, y, n = max(gains, key=lambda x: x[:2])
        f = -f
        values = (part(a, 1, y)[2], part(a, 0, y)[2], part(b, 1, n)[2], part(b, 0, n)[2])
        trees.append((f, a, b, *values))
        for c in cells:
            raw[c] += (values[0] if c >> a & 1 else values[1]) if c >> f & 1 else (values[2] if c >> b & 1 else values[3])
    model = Model(bias, tuple(trees), {})
    by_score: dict[str, dict[float, list[int]]] = {k: {} for k in (*FAMILIES, "all")}
    for c, (n, y) in held.items():
        for family in (family_of(c), "all"):
            x = by_score[family].setdefault(1 / (1 + math.exp(-model.raw(c))), [0, 0])
            x[0] += n
            x[1] += y

    def least(scores: dict[float, list[int]]) -> float:
        found, n, y = 2.0, 0, 0
        for s, x in sorted(scores.items(), reverse=True):
            n, y = n + x[0], y + x[1]
            if s >= LIKELY and y >= PRECISION * (n + y + 1):  # one more counterexample: few examples prove nothing
                found = s - 1e-9
        return found

    for family in FAMILIES:
        enough = sum(x[1] for x in by_score[family].values()) >= PRECISION / (1 - PRECISION)
        model.thresholds[family] = least(by_score[family if enough else "all"])
    return model


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row doc_id, the checked base spans by kind, ``loose``: all candidates that overlap none, with their cells, and ``examples`` and ``counterexamples``: the cells of base matches that pass and fail their checks, as they are and damaged."""
    text = F.coalesce(F.translate(F.col(text_col), MARK, INSTEAD), F.lit(""))
    out = df.select(F.col(id_col).alias("doc_id"), *carry, text.alias("__t"))
    at = F.contains("__t", F.lit("@")) | F.contains("__t", F.lit("(at)")) | F.contains("__t", F.lit("[at]"))
    may = {"email": F.contains("__t", F.lit("@")), "phone": F.contains("__t", F.lit("+")), "mail": at}
    for name, pattern in (BASE | LOOSE).items():
        out = pieces_of(out, f"__{name}", "__t", pattern, may[name] if name in may else F.col("__t").rlike(pattern.replace("{11,}+", "{11}").replace("{6,}+", "{6}")))

    def checked(kind: str) -> Column:
        return F.filter(f"__{kind}", lambda s: passes(kind, s["found"]))

    def failing(kind: str) -> Column:
        return F.filter(f"__{kind}", lambda s: ~passes(kind, s["found"]))

    for kind in KINDS:
        out = out.withColumn(f"__not_{kind}", failing(kind)).withColumn(f"__{kind}", checked(kind))

    def spans(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))).alias(kind)

    def told(kind: str, of: str) -> Column:
        family = {"email": "mail", "ip": "host"}.get(kind, "digits")
        shown = lambda s, form: F.struct(form.alias("found"), s["before"].alias("before"), s["after"].alias("after"))
        both = F.flatten(F.transform(of, lambda s: F.array(shown(s, s["found"]), shown(s, damaged(kind, s["found"])))))
        # once more without its context: personal data stands anywhere, and a corpus may hold it in few places only
        bare = F.lit(((1 << len(FEATURES)) - 1) ^ (1 << FEATURES.index("context")))
        return F.flatten(F.transform(F.transform(both, lambda s: features(s, family)), lambda c: F.array(c, c.bitwiseAND(bare))))

    examples, counter = (F.concat(*(told(kind, f"{prefix}{kind}") for kind in KINDS)).alias(name) for prefix, name in (("__", "examples"), ("__not_", "counterexamples")))
    out = out.select("doc_id", *carry, *map(spans, KINDS), examples, counter, *(f"__{k}" for k in LOOSE))

    def loose(family: str, name: str, kinds: tuple[str, ...]) -> Column:
        base = F.concat(*(F.col(k) for k in kinds))
        apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        n = lambda s: F.length(digits(s["found"]))
        kind = lambda s: F.lit({"mail": "email", "host": "ip"}[family]) if family != "digits" else F.when(F.startswith(s["found"], F.lit("+")) | (n(s) < 12), "phone").otherwise("card")
        return F.transform(F.filter(name, apart), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"), features(s, family).alias("cell")))

    digits_family = ("ip", "card", "phone")
    return out.select("doc_id", *carry, *KINDS, "examples", "counterexamples", F.concat(loose("mail", "__mail", ("email",)), loose("host", "__host", digits_family), loose("digits", "__digits", digits_family)).alias("loose"))


#: What a counted cell is known as: an example, a counterexample, or neither.
EXAMPLE, COUNTER, OPEN = 2, 1, 0


def weighed(cells: dict[int, list[int]], by: dict[int, list[int]]) -> dict[int, tuple[float, float]]:
    """(counterexamples, examples) of counts (open, counter, example) by cell.

    Open candidates are counterexamples only as far as what is known of their cell leaves room for it: where ``by`` has k counterexamples and y examples of a cell, they
    weigh ``1 - y / (y + k + 1)``. So hidden personal data doesn't speak against itself, and a cell without examples counts in full.
    """
    out = {}
    for cell, (n, k, y) in cells.items():
        _, known, examples = by.get(cell, (0, 0, 0))
        out[cell] = (k + n * (1 - examples / (examples + known + 1)), y)
    return out


def fit(found: DataFrame) -> Model:
    """Count the cells over all candidates and examples, boost, and calibrate on the fold whose id's checksum leaves 2 when divided by 4."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    of = lambda name, known: F.transform(name, lambda c: F.struct((c["cell"] if name == "loose" else c).alias("cell"), F.lit(known).alias("known")))
    told = F.concat(of("examples", EXAMPLE), of("counterexamples", COUNTER), of("loose", OPEN))
    # at most 2 ** len(FEATURES) cells x 3 x 2
    rows = found.select(held.alias("held"), F.explode(told).alias("c")).groupBy("held", "c.cell", "c.known").agg(F.count("*").alias("n")).collect()
    folds: dict[bool, dict[int, list[int]]] = {False: {}, True: {}}
    for r in sorted(rows, key=lambda r: (r["held"], r["cell"], r["known"])):
        folds[r["held"]].setdefault(r["cell"], [0, 0, 0])[r["known"]] += r["n"]
    return boost(weighed(folds[False], folds[False]), weighed(folds[True], folds[False]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, the ``base`` spans and ``spans``, all selected ones: arrays of (start, rank, kind, end) in order.

    A null text is an empty one and has no spans; repeated rows are repeated; where the corpus has
    too few base spans held out to show the precision, in a family and in all together, nothing is added. Added spans that overlap a base span are left out, and so
    is an added span that starts within another. One scan, no shuffle but that of the cell counts.
    """
    found = staged(candidates(df, id_col, text_col, carry), "candidates")
    model = fit(found)
    rank = lambda kind: F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)
    shape = lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.concat(*(F.col(k) for k in KINDS)), shape))
    scored = F.filter("loose", lambda s: model.selects(s["cell"]))
    out = found.withColumn("base", base).withColumn("__scored", scored)
    # of candidates that overlap, the one that starts first stays; a host's digits may be those of a run, which it precedes by its kind
    inside = lambda s, o: ((o["start"] < s["start"]) & (s["start"] < o["end"])) | ((o["start"] == s["start"]) & (o["kind"] == "ip") & (s["kind"] != "ip"))
    clear = F.filter("__scored", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & ~F.exists("__scored", lambda o: inside(s, o)))
    return out.withColumn("spans", F.when((F.size("base") >= 0) & (F.size("__scored") > 0), F.array_distinct(F.array_sort(F.concat("base", F.transform(clear, shape))))).otherwise(F.col("base"))).drop("__scored", "examples", "counterexamples")


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one stands, longer ones cover what follows."""
    start = F.aggregate(
        spans,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] + 1 < acc["at"], F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((s["end"] + 1).alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"], s["start"] + 1 - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"], F.length(F.col(text)))),
    )
    return F.when(F.size(spans) > 0, start).otherwise(F.col(text))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
