"""Main text of web pages with a site style tree.

The pages of a host are merged by the paths of their elements (tag and classes). For each element of the merged tree
that has text, two importances follow from entropies over the host's pages: of presentation (how much the order of its
children varies) and of content (how little its pieces of text repeat, each counted as often as it occurs). Pages with
the same article count once, so copies of an article are not taken for boilerplate. Where a host has few pages, the
importance leans on that of the same element over the registered domain, and on whether it stands outside the article.
Elements of low importance are boilerplate and are taken out of each page.

What entropies can't see goes by names: what HTML itself names as navigation, forms, scripts and so on, what is hidden,
and reader comments, each of which is unique.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, small_batches, strings, written

# Names in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title nav footer aside form noscript template iframe object svg canvas audio video button select option input textarea label dialog menu datalist fieldset".split())
RAW = frozenset("script style".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("table ul ol dl div section article main body nav aside footer header form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<bare>/?)(?P<open>[A-Za-z][^\s/>]*)(?P<left>[^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(frozen=True)
class StyleTree:
    """Parameters of the merged tree."""

    #: Weight of the content; the rest is of the presentation.
    content_weight: float = 0.9
    #: Branches less important than this are taken out.
    least_importance: float = 0.72
    #: The domain's tree counts as so many pages of the host at most.
    domain_pages: float = 32.0
    #: The prior counts as so many pages: 1, or less by this much if an element always stands outside a page's article.
    prior_pages: float = 16.0
    outside: float = 0.8


class Element:
    __slots__ = ("children", "low", "main", "noise", "path", "tag")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, low: bool) -> None:
        self.tag, self.path, self.noise, self.main, self.low = tag, path, noise, main, low
        self.children: list[str] = []


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}


def is_noise(tag: str, found: dict[str, str], in_main: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or HIDDEN.search(found.get("style", "").lower()):
        return True
    if tag in ("html", "body", "main"):
        return False
    return bool(COMMENT_WORDS.intersection(SPLIT.split(f"{found.get('class', '')} {found.get('id', '')}".lower())))


class Page:
    """Blocks of text of a page in order, and its elements by path."""

    def __init__(self, text: str, low: frozenset[int] | set[int] = frozenset()) -> None:
        #: (text, noise, in the article, low, path)
        self.blocks: list[tuple[str, bool, bool, bool, int]] = []
        self.shapes: dict[int, list[str]] = {}
        self.low = low
        self.stack = [Element("", 0, False, False, False)]
        self.open: Counter = Counter()
        self.buffer: list[str] = []
        at, last = 0, text.rfind(">")  # nothing behind it is a tag
        while at <= last and (m := TOKEN.search(text, at)):
            if m.start() > at:
                self.buffer.append(text[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["open"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"] or m["bare"]:
                self._end(tag)
                continue
            rest = m["rest"] if m["tag"] else m["left"]
            self._start(tag, attributes(rest or ""), (rest or "").endswith("/"))
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                at = close.end() if close else len(text)
        self.buffer.append(text[at:])
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                e = self.stack[-1]
                self.blocks.append((text, e.noise, e.main, e.low, e.path))

    def _pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        self.shapes.setdefault(e.path, []).extend(e.children)

    def _start(self, tag: str, found: dict[str, str], closed: bool) -> None:
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.buffer.append(" ")
        if tag in RAW:
            return
        if tag not in INLINE:
            self._close_implied(tag)
        parent = self.stack[-1]
        parent.children.append(tag)
        if tag in VOID:
            return
        noise = parent.noise or is_noise(tag, found, parent.main)
        main = parent.main or (tag in ("article", "main") and not noise)
        if tag in INLINE and not (noise and not parent.noise):
            e = Element(tag, parent.path, noise, main, parent.low)
        else:
            if tag in INLINE:
                self._flush()
            label = f"{parent.path:x}/{tag}.{' '.join(sorted(found.get('class', '').lower().split()))}"
            path = xxhash.xxh3_64_intdigest(label) >> 1
            e = Element(tag, path, noise, main, path in self.low)
        self.stack.append(e)
        self.open[tag] += 1
        if closed and tag not in ("p", "div", "span", "a"):
            self._end(tag)

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and rows end their like."""
        ends = CLOSES.get(tag, set()) | ({"p"} if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") else set())
        if not any(self.open[x] > 0 for x in ends):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i].tag
            if name in ends:
                while len(self.stack) > i:
                    self._pop()
                ends = ends - {"p"} if name == "p" else ends
                if not any(self.open[x] > 0 for x in ends):
                    return
            elif name in SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.open[tag] <= 0:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if self.stack[i].noise and not self.stack[i - 1].noise:
                    self._flush()
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return

    def text(self) -> str:
        """The blocks of the main text, joined by empty lines."""
        good = [b for b in self.blocks if not b[1]]
        found = [b for b in good if not b[3]] or [b for b in good if b[2]] or good
        return "\n\n".join(b[0] for b in found)

    def features(self) -> Iterator[tuple[int, bool, int, int]]:
        """(path, is content, hash, whether it is outside the article) once each, of each element with text: its pieces of text, and the order of its children."""
        has_main = any(b[2] for b in self.blocks)
        where = {b[4]: int(has_main and not b[2]) for b in self.blocks}
        for path, outside in where.items():
            yield path, False, xxhash.xxh3_64_intdigest(" ".join(self.shapes.get(path, ()))) >> 1, outside
        for path, feature in {(b[4], xxhash.xxh3_64_intdigest(b[0]) >> 1) for b in self.blocks}:
            yield path, True, feature, where[path]

    def fingerprint(self) -> int:
        """The least hash of the article's blocks, or of all: the same for copies, and for most near copies."""
        inner = [b[0] for b in self.blocks if b[2] and not b[1]] or [b[0] for b in self.blocks]
        return min((xxhash.xxh3_64_intdigest(x) >> 1 for x in inner), default=0)


def style_importance(pages: DataFrame, tree: StyleTree = StyleTree()) -> DataFrame:
    """(site, path, n_pages, presentation, content, importance) of each element with text of each host's merged tree, from ``pages(site, domain, html)``.

    ``n_pages`` counts pages with different articles. ``presentation`` and ``content`` are of the host alone;
    ``importance`` is their weighted sum, smoothed by the domain's and by the prior.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(strings(batch.column(2))):
                page = Page(text)
                mark, n = page.fingerprint(), len(found)
                found += [(*f, mark) for f in page.features()]
                rows += [k] * (len(found) - n)
            columns = zip(*found, strict=True) if found else [()] * 5
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["site", "domain", "path", "content", "feature", "outside", "article"])

    features = pages.select("site", "domain", "html").mapInArrow(run, "site long, domain long, path long, content boolean, feature long, outside int, article long")
    once = features.groupBy("site", "domain", "path", "content", "feature", "article").agg(F.max("outside").alias("outside"))
    counted = once.groupBy("site", "domain", "path", "content", "feature").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("outside").cast("double").alias("outside"))
    counted = written(counted)
    host = _importances(counted, ["site", "domain", "path"], tree)
    wide = counted.groupBy("domain", "path", "content", "feature").agg(F.sum("k").alias("k"), F.sum("outside").alias("outside"))
    domain = _importances(wide, ["domain", "path"], tree).select("domain", "path", F.least("m", F.lit(tree.domain_pages)).alias("domain_m"), F.col("importance").alias("of_domain"))
    prior = F.lit(1.0) - F.col("outside") / F.col("m") * F.lit(tree.outside)
    smoothed = (F.col("m") * F.col("importance") + F.col("domain_m") * F.col("of_domain") + F.lit(tree.prior_pages) * prior) / (F.col("m") + F.col("domain_m") + F.lit(tree.prior_pages))
    return host.join(domain, ["domain", "path"]).select("site", "path", F.col("m").cast("long").alias("n_pages"), "presentation", "content", smoothed.alias("importance"))


def _importances(counted: DataFrame, keys: list[str], tree: StyleTree) -> DataFrame:
    """(keys, m, outside, presentation, content, importance) from ``counted(keys, content, feature, k, outside)``: one minus the mean entropy of features; 1 for a single page."""
    k, shape = F.col("k"), ~F.col("content")
    merged = counted.groupBy(*keys).agg(
        F.sum(F.when(shape, k)).alias("m"),
        F.sum(F.when(shape, F.col("outside"))).alias("outside"),
        F.sum(F.when(shape, k * F.log(k))).alias("shapes"),
        F.sum(F.when(F.col("content"), k)).alias("pieces"),
        F.sum(F.when(F.col("content"), k * F.log(k))).alias("repeats"),
    )
    log_m = F.log("m")
    presentation = F.when(F.col("m") > 1, (log_m - F.col("shapes") / F.col("m")) / log_m).otherwise(F.lit(1.0))
    content = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), F.lit(1.0) - F.col("repeats") / F.col("pieces") / log_m)).otherwise(F.lit(1.0))
    w = tree.content_weight
    return merged.select(*keys, "m", "outside", presentation.alias("presentation"), content.alias("content"), (presentation * (1 - w) + content * w).alias("importance"))


def extract_text(pages: DataFrame, tree: StyleTree = StyleTree(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row; the text is empty if a page has none.

    A null or empty page has an empty text; pages without a host are one site; the last two names of a host are its
    domain. If all blocks of a page were of low importance, those of its article stay, or all. Repeated rows each get a
    row; an empty table gives an empty result; other columns are ignored. Unclosed and wrongly nested elements are
    closed as HTML prescribes for paragraphs, list items and cells. The time for a page grows in proportion to its
    length and its depth.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    host = ascii_lower(F.coalesce(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1), F.lit("")))
    sited = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host).alias("site"), F.xxhash64(F.substring_index(host, ".", -2)).alias("domain"))
    low = style_importance(sited, tree).where(F.col("importance") < tree.least_importance)
    lists = written(low.groupBy("site").agg(F.collect_list("path").alias("low")))
    wide = sited.join(broadcast_if_small(lists, 1_000_000, "low"), "site", "left").select("id", "url", "html", "low")
    kinds = dict(sited.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(text, set(low or ())).text() for text, low in zip(strings(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return wide.mapInArrow(run, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long")
