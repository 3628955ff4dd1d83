"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams a page's events once.  Block-level tags
end a line; each line knows its characters, its tags, its region (the nearest
container) and whether it stands within something that is never content
(navigation, adverts, forms, scripts, comments of readers ...).  The text-to-tag
ratios of the lines are smoothed with a Gaussian, and lines over a threshold (the
spread of the smoothed ratios) are the seeds of content clusters.  Where seeds lie
in articles or a main element, these are the content; else it is the smallest
region that holds all clusters, without those of its parts that have no cluster
and are mostly links.  The content gives all its lines, so a short paragraph stays.

Class, id and role values are read as words (split at hyphens, underscores and
capitals).  Words for adverts, navigation, reader comments, consent and the like
leave an element out if they stand first or last (`cookie-consent`, `google-ad`,
but not `category-ads`), whatever the element.  Words that may as well name content (`search`,
`notice`, `banner`) leave it out only if all other words are mere parts of a layout
(`notice-box`), and if it doesn't hold most of the seeds.  Elements that aren't
shown, and those marked as comments by their item type, are left out.  The
headings in an article's own header stay.

Defined results: a page without text, or with null html, gives an empty string;
broken, unclosed or truncated markup is read as far as it goes; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Tags whose text is never content, tags that hold no text at all, and void tags.
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select fieldset".split())
SILENT = frozenset(
    "script style noscript template iframe object svg math canvas audio video head title textarea".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
REGION = frozenset("article main section div body td table ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the page; no word leaves them out.
WHOLE = frozenset("html body main".split())
#: Words that say that an element isn't the article, wherever it stands.
STRONG = frozenset(
    "ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored cookie cookies consent gdpr newsletter newsletters "
    "subscribe signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars comment comments commentlist disqus reply replies pagination pager popup popups modal modals "
    "notification notifications toolbar masthead recommended recommendations contentinfo complementary".split()
)
#: Words that say so of an element without most of the text; words behind `related` that make a list of links of it.
DOUBTFUL = frozenset(
    "notice notices alert alerts banner banners promo promos promotion promotions widget widgets share sharing social respond login signin footer header search skip dialog toast overlay".split()
)
LISTED = frozenset("post posts article articles link links content stories items reading".split())
#: Words for parts of a layout, and words that turn the meaning of those behind them.
PLAIN = frozenset(
    "box bar container wrap wrapper section area block list form slot unit link links notice overlay button buttons icon icons top bottom left right inner outer site page main global post article user reader js "
    "item items title body content text message".split()
)
TURNED = frozenset("category cat tag has no non not with without is type".split())
STATES = frozenset("open closed on off enabled disabled free status".split())
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
TWO = re.compile(r"(?i)\b(pop|sign|log)[-_](up|in)\b")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


def said_by(value: str) -> str:
    """What a class, id or role says of its element: "all" (left out), "maybe" or nothing."""
    words = [w.lower() for w in WORD.findall(TWO.sub(r"\1\2", value))]
    if not words or words[0] in TURNED or words[-1] in STATES:
        return ""
    if words[0] in STRONG or words[-1] in STRONG or (words[0] == "related" and len(words) > 1 and words[1] in LISTED):
        return "all"
    some = [w for w in words if w in DOUBTFUL]
    return "maybe" if some and all(w in DOUBTFUL or w in PLAIN for w in words) else ""


#: An open tag on the left ends when one on the right begins, as the optional end tags of HTML say.
IMPLIED = {"p": BLOCK - {"li"} | {"li"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
SPACE = re.compile(r"\s+")
#: This share of characters in links makes a line no seed, and a part without a cluster a menu.
LINKED = 0.5


class Lines(HTMLParser):
    """Turns events into lines: [region, text parts, tags, in content?, characters in links, doubt].

    A doubt is the number of the outermost element that a doubtful word names (0: none).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, int, bool, int]] = []  # tag, left out ("", "header" or "all"), silent, region, in a link, doubt
        self.doubts = 0
        self.regions: list[str] = ["root"]
        self.parent: list[int] = [0]
        self.lines: list[list] = []
        self.current: list | None = None

    def line(self) -> list:
        if self.current is None:
            top = self.open[-1] if self.open else ("", "", False, 0, False, 0)
            self.current = [top[3], [], 1, not (top[1] or top[2]), 0, top[5]]
            self.lines.append(self.current)
        return self.current

    def handle_starttag(self, tag, attrs) -> None:
        while self.open and tag in IMPLIED.get(self.open[-1][0], ()):
            self.open.pop()
        if tag == "p" and any(x[0] == "p" for x in self.open):  # an unclosed <p><b> ends as well
            while self.open.pop()[0] != "p":
                pass
        if tag in BLOCK:
            self.current = None
        elif tag == "br":
            self.line()[1].append(" ")
        if tag in VOID:
            self.line()[2] += 1
            return
        _, out, silent, region, link, doubt = self.open[-1] if self.open else ("", "", False, 0, False, 0)
        names = dict(attrs)
        before = doubt
        if out == "header" and tag in HEADINGS:
            out = ""  # a heading in the article's own header
        if tag == "header" and not out and any(x[0] == "article" for x in self.open):
            out = "header"
        elif tag in BOILERPLATE or "hidden" in names or names.get("aria-hidden") == "true" or HIDDEN.search(names.get("style") or ""):
            out = "all"
        elif names.get("itemprop") == "comment" or (names.get("itemtype") or "").endswith("/Comment"):
            out = "all"
        elif not out and tag not in WHOLE:
            said = {said_by(v) for k in ("class", "id", "role") for v in (names.get(k) or "").split()}
            out = "all" if "all" in said else ""
            if "maybe" in said and not doubt:
                self.doubts += 1
                doubt = self.doubts
        if tag in REGION:
            self.regions.append(tag)
            self.parent.append(region)
            region = len(self.regions) - 1
        self.open.append((tag, out, silent or tag in SILENT, region, link or tag == "a", doubt))
        if tag not in BLOCK:
            if (out or doubt != before) and self.current is not None and self.current[3]:
                self.current = None  # an inline element that is left out is no part of its line
            self.line()[2] += 1

    def handle_endtag(self, tag) -> None:
        if not any(x[0] == tag for x in self.open):
            return
        _, was, _, _, _, doubt = self.open[-1]
        while self.open.pop()[0] != tag:
            pass
        if tag in BLOCK or was and not (self.open and self.open[-1][1]) or doubt != (self.open[-1][5] if self.open else 0):
            self.current = None

    def handle_data(self, data) -> None:
        if self.open and self.open[-1][2]:
            return
        if self.current is None and not data.strip():
            return
        line = self.line()
        line[1].append(data)
        if self.open and self.open[-1][4]:
            line[4] += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over two sigma to either side; the ends repeat."""
    half = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, half, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(r, text, tags, ok, linked, doubt) for r, parts, tags, ok, linked, doubt in parser.lines if (text := SPACE.sub(" ", "".join(parts)).strip())]
    if not any(x[3] for x in lines):
        return ""
    found = seeds_of(lines)
    if parser.doubts:  # a doubtful element stays if it holds most of the seeds
        chars = [0] * (parser.doubts + 1)
        for i in found:
            chars[lines[i][5]] += len(lines[i][1])
        lines = [(r, text, tags, ok and (not doubt or 2 * chars[doubt] > sum(chars)), linked, doubt) for r, text, tags, ok, linked, doubt in lines]
        found = seeds_of(lines)
    seeds = [lines[i][0] for i in found]
    seeds = seeds or [line[0] for line in lines if line[3]]
    chosen = chosen_regions(parser.regions, parser.parent, seeds, lines)
    return "\n\n".join(text for region, text, _, ok, _, _ in lines if ok and chosen[region])


def seeds_of(lines: list[tuple]) -> list[int]:
    """The lines whose smoothed ratio of text to tags is over the ratios' spread, and that aren't mostly links."""
    ratios = smoothed(np.array([len(text) / tags * ok for _, text, tags, ok, _, _ in lines]))
    over = ratios >= ratios.std()
    return [i for i, (_, text, _, ok, linked, _) in enumerate(lines) if over[i] and ok and linked < LINKED * len(text)]


def chosen_regions(kinds: list[str], parent: list[int], seeds: list[int], lines: list[tuple]) -> list[bool]:
    """Whether the lines of each region are content; a region's parent has a smaller number."""
    n = len(kinds)
    named = [False] * n
    for r in range(1, n):
        named[r] = kinds[r] in ("article", "main") or named[parent[r]]
    if any(named[r] for r in seeds):
        return named
    # the smallest region that holds all seeds, and those that hold some
    held = [0] * n
    for r in seeds:
        held[r] += 1
    chars, linked = [0] * n, [0] * n
    for r, text, _, ok, links, _ in lines:
        chars[r] += len(text) * ok
        linked[r] += links * ok
    for r in range(n - 1, 0, -1):
        for total in (held, chars, linked):
            total[parent[r]] += total[r]
    root = max(r for r in range(n) if held[r] == len(seeds))
    inside = [r == root for r in range(n)]
    for r in range(1, n):
        menu = not held[r] and linked[r] >= LINKED * chars[r] > 0
        inside[r] = inside[r] or inside[parent[r]] and not menu
    return inside


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its main text, blocks in page order joined by an empty line."""
    small_batches(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(extracted, SCHEMA)
