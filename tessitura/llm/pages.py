"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A *style node* is an element with the path of tags and classes
that leads to it. For every node of a host the tree holds how many pages have it, which sequences of child
tags it has there (presentation) and which texts it holds itself (content). A node whose pages all look different in it
carries what the pages are about; one that looks alike everywhere belongs to the site. Importance is one less the
entropy of its texts over the pages, with a share of the entropy of its presentation, times a prior; what has low importance is
cut out of each page, inside an article as well as outside. The prior is zero for elements that are boilerplate by what they are (menus, scripts, ...) and ``HINTED``
for those whose class, id or tag hints at it, unless they hold the article. Parts of an article are
told with the article's text instead of the page, so copies of an article count once, whatever stands around them, and keep their text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import map_batches, staged, table

#: Share of the content in a node's importance; importance below which a branch goes.
CONTENT_SHARE, LOW = 0.9, 0.25
#: Prior of what a class, id or tag hints at: such an element goes even on a single page, of which the tree can tell nothing.
HINTED = 0.2
#: Share of the article's text that an element must hold to be taken for a wrapper whatever its class says, and most that low branches may cut of it.
HALF = 0.5
#: Bytes of low branches up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20

TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html head body td th tr tbody thead tfoot caption option".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold no article text whatever the site does.
NEVER = frozenset("head nav aside footer button select dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that tell of such elements, unless they hold the article.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|menu|navbar|nav|navigation|breadcrumbs?|sidebar|side|aside|footer|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|comments?|disqus|replies|responses|widget|login|signin|signup|search|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
OUTER_HINT = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    parent: int
    hard: bool
    soft: bool
    own: bool
    article: bool
    look: int = 0
    start: int = 0
    end: int = 0


@dataclass
class Page:
    """Elements in the order in which they open (0 stands for the page), each with the range of its blocks; texts of the blocks and the elements that hold them."""

    elements: list[Element]
    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    prior: np.ndarray | None = None


def number(text: str, seed: int) -> int:
    """63 bits that stand for a text."""
    return xxhash.xxh64_intdigest(text, seed) >> 1


def covered(elements: Iterable[Element], n: int) -> np.ndarray:
    """Which of n blocks lie in one of the elements."""
    step = np.zeros(n + 1, np.int64)
    for e in elements:
        step[e.start] += 1
        step[e.end] -= 1
    return np.cumsum(step[:-1]) > 0


def parse(source: str | None) -> Page:
    """The page's elements and text blocks in one pass, in time linear in its length but for closing tags far inside.

    Nothing is collected in elements that never hold text of an article. Blocks in an element whose class, id or tag only hints at that
    have the prior ``HINTED``, unless it holds over ``HALF`` of the text of the page's articles (of all text if it has none).
    """
    source = source or ""
    page = Page([Element("", 0, -1, False, False, False, False)])
    elements, texts, owners = page.elements, page.texts, page.owners
    stack, open_tags, words = [0], Counter(), []

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text and not elements[stack[-1]].hard:
            texts.append(text)
            owners.append(stack[-1])

    def close(to: int) -> None:
        while len(stack) > to:
            e = elements[stack.pop()]
            open_tags[e.tag] -= 1
            e.end = len(texts)

    def innermost(tags: Collection[str]) -> int:
        """The place in the stack of the innermost open element of some tags."""
        if not any(open_tags[t] for t in tags):
            return 0
        return next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag in tags)

    at, last = 0, source.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    while True:
        m = TAG.search(source, at, last) if at < last else None
        note = source.find("<!--", at) if not m else -1
        if not elements[stack[-1]].hard:
            words.append(html.unescape(source[at : m.start() if m else note if note >= 0 else None]))
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = source.find("-->", at)
            at = end + 3 if end >= 0 else len(source)
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush()
            i = innermost((tag,))
            if i:
                close(i)
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and open_tags["p"]:
                i = innermost(("p", "td", "th", "table", "article", "main", "body"))
                if elements[stack[i]].tag == "p":
                    close(i)
            if tag in SIBLINGS:
                i = innermost((*SIBLINGS[tag], "ul", "ol", "dl", "table", "select"))
                if i and elements[stack[i]].tag in SIBLINGS[tag]:
                    close(i)
        above = elements[stack[-1]]
        above.look = number(tag, above.look)
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            continue
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3] or m[6] or "")}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role", "").lower()
        own = tag in ("article", "main") or role == "main"
        article = above.article or own
        hard = above.hard or tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        soft = tag == "form" or role in ROLES or bool(names and tag not in ("html", "body", "main") and HINT.search(names))
        soft = soft or (not article and (tag == "header" or bool(names and tag not in ("html", "body") and OUTER_HINT.search(names))))
        # numbers in classes and ids tell pages apart, not styles
        path = number(f"{tag}.{'.'.join(sorted(set(re.sub('[0-9]+', '0', names).split())))}", above.path)
        stack.append(len(elements))
        open_tags[tag] += 1
        elements.append(Element(tag, path, stack[-2], hard, soft, own, article, 0, len(texts)))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.start() if end else len(source)
    flush()
    close(0)
    sizes = np.array(list(map(len, texts)), np.int64)
    own = covered((e for e in elements if e.own and not e.hard), len(texts))
    sums = np.concatenate(([0], np.cumsum(sizes * own if own.any() else sizes)))
    page.prior = np.where(covered((e for e in elements if e.soft and sums[e.end] - sums[e.start] <= HALF * sums[-1]), len(texts)), HINTED, 1.0)
    return page


def main_text(source: str | None, low: Mapping[int, float] | Collection[int] = frozenset()) -> str:
    """The blocks of the page's articles, or of all its body if it has none, joined by line feeds, without those of low importance.

    ``low`` has the importance in the host's tree by path, 1 for paths that it lacks (0 for those of a plain collection). Where the tree would cut over ``HALF`` of an article's
    text, the site's pages are too alike to tell what is theirs, and the article is judged by its prior alone.
    """
    page = parse(source)
    n = len(page.texts)
    told = low if isinstance(low, Mapping) else dict.fromkeys(low, 0.0)
    tree = np.array([told.get(page.elements[i].path, 1.0) for i in page.owners])
    article = covered((e for e in page.elements if e.own and not e.hard), n)
    known = page.prior >= LOW
    keep = known & (page.prior * tree >= LOW)
    own = article & known
    if own.any():
        sizes = np.array(list(map(len, page.texts)), np.int64)
        keep = own if sizes[own & ~keep].sum() > HALF * sizes[own].sum() else own & keep
    return "\n".join(page.texts[i] for i in np.flatnonzero(keep).tolist())


def features(source: str | None, page: int = 0) -> set[tuple[int, int, bool, int]]:
    """(page, path, whether of content, feature) as numbers for every style node that holds text: its presentation and its own texts, boilerplate included. Parts of an article have a number of the article's text for the page's."""
    found = parse(source)
    elements = found.elements
    story = number("\n".join(t for t, i, prior in zip(found.texts, found.owners, found.prior.tolist()) if elements[i].article and prior == 1), 3)
    out = set()
    for text, at in zip(found.texts, found.owners):
        e = elements[at]
        if at > 0:
            own = story if e.article else page
            out.add((own, e.path, False, e.look))
            out.add((own, e.path, True, number(text, 0)))
    return out


def host_of(url: str) -> Column:
    """A number for the host of a url, the empty one's if it has none."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path (a number), pages and importance of every style node.

    ``pages`` has host and html. Pages of a host that are copies count once: a feature is told with its page's hash, and
    what is told again goes before it is counted. All keys are numbers, and features are counted by host, path and
    feature before anything is gathered, so a host with a third of all pages is spread over all tasks.
    With n of m pages showing a text, its entropy over the pages is log n / log m, of which the mean over all showings is taken; presentation
    has the entropy of its distribution. Few pages say little: the unimportance that is found weighs 1 - 1 / m, so on a single page everything is important.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: set[tuple] = set()
        known: set[tuple] = set()
        for host, page, source in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, page) not in known:
                known.add((host, page))
                rows.update((host, *f) for f in features(source, page))
        told = list(rows)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in told], k) for i, k in enumerate(kinds)], ["host", "page", "path", "content", "feature"])

    seen = map_batches(pages.select("host", F.xxhash64("html").alias("page"), "html"), run, "host bigint, page bigint, path bigint, content boolean, feature bigint")
    counts = seen.distinct().groupBy("host", "path", "content", "feature").agg(F.count("*").alias("n"))
    # a page may have several elements of one path; it counts once for each look that they have
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("content"), F.col("n"))).alias("pages"),
        (F.sum(F.when(F.col("content"), F.col("n") * F.log("n"))) / F.sum(F.when(F.col("content"), F.col("n")))).alias("text_log"),
        F.sum(F.when(~F.col("content"), F.col("n") * F.log("n"))).alias("style_nlog"),
    )
    m = F.log("pages")
    content = F.when(F.col("pages") > 1, 1 - F.col("text_log") / m).otherwise(1.0)
    presentation = F.when(F.col("pages") > 1, (m - F.col("style_nlog") / F.col("pages")) / m).otherwise(1.0)
    found = F.coalesce(content, F.lit(1.0)) * CONTENT_SHARE + presentation * (1 - CONTENT_SHARE)
    return sums.select("host", "path", "pages", (1 - (1 - 1 / F.col("pages")) * (1 - found)).alias("importance"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Branches of low importance in the host's style tree are cut, inside an article too. A null page
    is an empty one, a null url or one without a host belongs to the host ``''``; repeated rows are repeated;
    broken markup is read as far as it goes.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    tree = style_tree(base.where(F.col("html").isNotNull()).select("host", "html"))
    low = staged(tree.where(F.col("importance") < LOW).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "low-branches")
    bytes_of = low.agg(F.coalesce(F.sum(F.size("low") * 8 + 48), F.lit(0))).first()[0]
    low = F.broadcast(low) if bytes_of <= BROADCAST_BYTES else low
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(source, frozenset(cut or ())) for source, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(base.join(low, "host", "left").select("page_id", "url", "html", "low"), run, f"page_id {id_type}, url string, text string, n_chars bigint")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))
