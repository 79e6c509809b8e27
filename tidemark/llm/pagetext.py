"""HTML extraction by tag-path ratios.

A page is read into blocks of text in page order.  Each block has a root-to-leaf tag path (interned, so deep
pages cost no more).  Per path, text length per node, punctuation per character and the share of link text are
summed; the fused score of a path is log(1 + text per node) * (1 + punctuation) * (1 - link share).  Scores are
smoothed along the page over neighbouring blocks, and blocks whose score reaches the page's threshold (half of
the text-weighted mean) are content nodes.  The article is the smallest container that holds most of the
content nodes' text; every block in it is kept, short ones too, except what is marked as something else:
menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag,
role, or a word of class or id.  A page without such a container keeps the blocks that pass the threshold.

Inside a block white space (and ``<br>``) becomes one space; character references are decoded; blocks are
joined by an empty line.  Nothing is capped.

Edge cases: null or empty html gives an empty text; broken markup (unclosed or crossed tags, a page cut off
in the middle, stray ``<``) is read as far as it goes; repeated pages give equal rows; an empty table gives
no rows; columns of the input are kept by ``extract``.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd blockquote figcaption caption summary address legend".split())
_OUT_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea dialog menu head "
                      "title svg math object fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies discuss disqus footer form gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split())
_SAFE_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: An open element of the second set is closed by the start of one of the first, up to a boundary.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
           "option": ({"option"}, {"select"})}
_P_BOUNDARY = frozenset("article aside blockquote body button caption div footer form header html li main nav object section table td "
                        "template th".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|[^<]+|<(?![a-zA-Z!?/])|</(?![a-zA-Z])", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？।]")
#: Share of the content nodes' text that the article must hold.
_MOST = 0.7


class _Page:
    """Blocks of one page, with the element each stands in."""

    def __init__(self) -> None:
        self.parent, self.tag, self.out = [-1], ["#"], [False]  # by element
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, int, str, int]] = []  # (element, path, text, link characters)
        self.stack: list[tuple[str, int, int]] = [("#", 0, 0)]  # (tag, element, path)
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.link = 0
        self.at = (0, 0)

    def flush(self) -> None:
        if self.text:
            t = " ".join(_html.unescape("".join(self.text)).split())
            if t:
                self.blocks.append((*self.at, t, self.link))
            self.text, self.link = [], 0

    def add(self, text: str) -> None:
        tag, element, path = self.stack[-1]
        if self.out[element]:
            return
        if not self.text:
            for t, e, p in reversed(self.stack):
                if t in _BLOCK or t == "#":
                    self.at = (e, path)
                    break
        self.text.append(text)
        if self.open.get("a"):
            self.link += len(text.strip())

    def start(self, tag: str, attrs: str) -> None:
        if tag in _BLOCK:
            self.flush()
            if self.open.get("p"):
                self.close({"p"}, _P_BOUNDARY)
        if tag in _CLOSES:
            self.close(*_CLOSES[tag])
        if tag in _VOID:
            if tag == "br":
                self.add(" ")
            return
        element, path = self.stack[-1][1:]
        out = self.out[element] or tag in _OUT_TAGS or self.marked(tag, attrs)
        self.parent.append(element)
        self.tag.append(tag)
        self.out.append(out)
        self.stack.append((tag, len(self.tag) - 1, self.paths.setdefault((path, tag), len(self.paths) + 1)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def marked(self, tag: str, attrs: str) -> bool:
        if tag == "header":  # a page's header; an article's or section's own header stays
            return not (self.open.get("article") or self.open.get("main") or self.open.get("section"))
        if not attrs or tag in _SAFE_TAGS:
            return False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" and tag in _BLOCK:
                return True
            if name == "role" and value.lower() in _OUT_ROLES:
                return True
            if name in ("class", "id") and not _OUT_WORDS.isdisjoint(_SPLIT.split(_CAMEL.sub("-", value).lower())):
                return True
        return False

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        if tag in _BLOCK:
            self.flush()

    def close(self, tags: set[str], boundary) -> None:
        """Close the nearest open element of ``tags`` unless a boundary stands before it."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in boundary:
                return

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


def _read(page: str) -> _Page:
    p, at, n = _Page(), 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag whose quote never closes: up to the next bracket
            cut = page.find(">", at)
            at = n if cut < 0 else cut + 1
            continue
        at = m.end()
        if m[2] is None:
            if not m[0].startswith(("<!", "<?")):
                p.add(m[0])
            continue
        tag = m[2].lower()
        if m[1]:
            p.end(tag)
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        p.start(tag, m[3])
    p.flush()
    return p


def _scores(p: _Page) -> list[float]:
    """Smoothed fused score of each block's path."""
    paths: dict[int, list[float]] = {}
    for _, path, text, link in p.blocks:
        s = paths.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(text), len(_PUNCT.findall(text)), min(link, len(text)))):
            s[k] += v
    fused = {k: math.log1p(c / n) * (1 + 10 * q / c) * (1 - a / c) for k, (n, c, q, a) in paths.items()}
    raw = [fused[b[1]] for b in p.blocks]
    pad = [raw[0], *raw, raw[-1]] if raw else []
    return [(pad[i] + 2 * pad[i + 1] + pad[i + 2]) / 4 for i in range(len(raw))]


def extract_main(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    p = _read(page)
    if not p.blocks:
        return ""
    score = _scores(p)
    weight = sum(len(b[2]) for b in p.blocks)
    limit = 0.5 * sum(s * len(b[2]) for s, b in zip(score, p.blocks)) / weight
    content = [s >= limit for s in score]
    mass, blocks_in = [0] * len(p.tag), [0] * len(p.tag)
    for (element, _, text, _), ok in zip(p.blocks, content):
        mass[element] += len(text) * ok
        blocks_in[element] += 1
    children: dict[int, list[int]] = {}
    nested = set()  # containers with a block element inside
    for e in range(len(p.tag) - 1, 0, -1):  # children have greater numbers
        mass[p.parent[e]] += mass[e]
        if p.tag[e] in _BLOCK or e in nested:
            nested.add(p.parent[e])
        if p.tag[e] in _BLOCK and p.tag[e] not in _LEAF:
            children.setdefault(p.parent[e], []).append(e)
        else:
            children.setdefault(p.parent[e], []).extend(children.pop(e, ()))
    at = 0
    while p.tag[at] not in ("article", "main"):
        best = max(children.get(at, ()), key=mass.__getitem__, default=None)
        if best is None or mass[best] < _MOST * mass[at] or blocks_in[at] and p.tag[at] not in ("#", "html", "body"):
            break
        if best not in nested and p.tag[best] not in ("html", "body", "article", "main"):
            break  # a container of plain text: its neighbours may be the article's other paragraphs
        at = best
    inside = [False] * len(p.tag)
    inside[at] = True
    for e in range(at + 1, len(p.tag)):
        inside[e] = inside[p.parent[e]]
    whole = p.tag[at] not in ("#", "html", "body")
    kept = []
    for (element, _, text, link), ok in zip(p.blocks, content):
        if inside[element] and (whole or ok or p.tag[element] in _LEAF and link * 2 < len(text)):
            kept.append(text)
        elif whole and p.tag[element] == "h1":
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(extract_main)

    return pages.withColumn(out, main_text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def op6_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    x = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
