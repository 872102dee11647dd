"""Main text of web pages: streaming parser events, text-to-tag ratios of lines, Gaussian smoothing and threshold clustering.

The standard library's parser is fed a page piece by piece. Its events make lines (the text of one block element each) and count the tags in them.
A line's ratio is its text outside links over its tags. What a page's elements are called is a prior on it: lines of menus, page headers, footers,
sidebars, adverts, notices, forms and comments have ratio 0, lines of elements that only share a word with such names a quarter of theirs.
The ratios are smoothed with a Gaussian kernel; lines that reach the standard deviation of the smoothed ratios are content, runs of them clusters.

The region is the innermost element that holds nearly all the clusters' text, no deeper than the article or main element around it. Of an article or
main element all lines stay, the short ones too, but those of ratio 0 by name and elements of suspect names without a content line. Of any other
region the lines from the first cluster to the last stay, but runs of links; before and after these, paragraphs that stand beside a cluster's lines,
and headings above the region. Boilerplate told by class or id alone ends at an outermost article or main element inside it; under a whole name
(sidebar), or one of other articles (related-posts), only if no other such element has content.

Edge cases: null, empty and textless pages give an empty text; unclosed and misnested tags end where their container ends; pages of boilerplate alone
give an empty text; repeated rows give one result row each; a null page_id or url is carried through; other columns are ignored. Broken markup never
fails: unknown declarations are comments up to their first >, a tag, comment or declaration that the page's end cuts off is dropped, and where a quote never
ends the rest is read without quotes.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

#: Characters of a page that the parser gets at a time.
FEED = 1 << 16
SIGMA = 1.0
#: The share of the clusters' text that an element must hold to be gone into, and what a suspect name leaves of a ratio.
SHARE, SUSPECT = 0.9, 0.25
#: So many lines of links behind one another are a menu.
MENU = 3

#: Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("audio canvas datalist embed head iframe map math noembed noframes noscript object script select style svg template textarea title video".split())
BOILERPLATE = frozenset("aside button dialog footer form header input menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
REGIONS = frozenset("article main".split())
#: Elements that are made for a line of text each.
TEXTS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
#: Parts of class and id names that mark boilerplate.
NAMES = frozenset(
    "ad ads adv advert alert alerts adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup popular "
    "promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split()
)
#: Names of wrappers whose articles are not the page's own, whatever else is in the name.
OTHERS = frozenset("comment comments disqus popular promo promoted promotion recommended related replies respond sponsor sponsored".split())
#: Words that make a name one of a layout (has-sidebar), and those that make a header one of an article (post-header).
STATES = frozenset("has no not with without hide show".split())
OWN = frozenset("article content entry post story title".split())
PARTS = re.compile(r"[_-]+")
#: What starts a tag, comment or declaration, and what quotes a value in it.
TAG, QUOTES = re.compile(r"<[A-Za-z/!?]"), re.compile(r"[\"']")
#: Why an element is boilerplate: a word that qualifies a name (share-price), a whole name, its last word or one of OTHERS, or what it is.
PART, NAME, SURE = 1, 2, 3


def named_boilerplate(names: str, in_region: bool) -> int:
    """PART, NAME or 0 for the names of a class or an id."""
    level = 0
    for name in names.lower().split():
        words = PARTS.split(name)
        parts = set(words)
        found = parts & NAMES
        if found == {"header"} and (in_region or parts & OWN):  # the heading of an article
            continue
        if found and not parts & STATES:
            level = max(level, NAME if words[-1] in NAMES or found & OTHERS else PART)
    return level


#: Which open element a new one ends: a paragraph by any block, items by their like.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Open:
    """An element that has started: the number of its parent, its level of boilerplate, the region it is in, the outermost suspect element around it."""

    __slots__ = ("tag", "number", "parent", "level", "region", "suspect", "silent", "spare")

    def __init__(self, tag: str, number: int, parent: int, level: int, region: int, suspect: int, silent: bool, spare: bool) -> None:
        self.tag, self.number, self.parent, self.level = tag, number, parent, level
        self.region, self.suspect, self.silent, self.spare = region, suspect, silent, spare


class Line(NamedTuple):
    text: str
    linked: int
    tags: int
    of: Open


class Lines(HTMLParser):
    """Collects a page's lines, and its elements by number; these know their parents, so an element costs the same at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Open("", 0, 0, 0, 0, 0, False, False)]
        self.open = [self.elements[0]]
        self.held: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def _break(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.linked, self.tags, self.open[-1]))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _end(self, at: int) -> None:
        self._break()
        self.held.subtract(o.tag for o in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 1
        if tag in BLOCKS or tag == "hr":
            there = self.open[-1].tag
            if there == "p" or there in ENDED_BY.get(tag, ()) or there in HEADINGS and tag in HEADINGS:
                self._end(len(self.open) - 1)
            self._break()
            self.links = 0
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag not in BLOCKS and tag not in SILENT and tag not in BOILERPLATE:
            return
        top = self.open[-1]
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
        # A header inside an article is the article's own heading; the page's is boilerplate.
        sure = (tag in BOILERPLATE and not (tag == "header" and top.region)) or named.get("role") in ROLES or "hidden" in named or named.get("aria-hidden") == "true"
        by_name = max(named_boilerplate(named.get(k, ""), top.region > 0) for k in ("class", "id"))
        exempt = tag in ("html", "body", "main", *HEADINGS) or (tag == "article" and not top.region) or (tag == "header" and top.region)
        own = SURE if sure else 0 if exempt else by_name
        above, spare, suspect = top.level, top.spare, top.suspect
        # An outermost article or main element is not boilerplate for a word of a name around it; for a whole name it is only if the page has another.
        if tag in REGIONS and not own and (tag == "main" or not by_name) and not self.held[tag] and not self.held["article"]:
            suspect = 0
            if above == NAME:
                above, spare = 0, True
        number = len(self.elements)
        if own == PART:
            own, suspect = 0, suspect or number
        region = number if tag in REGIONS or named.get("role") in ("main", "article") else top.region
        new = Open(tag, number, top.number, max(above, own), region, suspect, top.silent or tag in SILENT, spare)
        self.elements.append(new)
        self.open.append(new)
        self.held[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in BLOCKS or tag in SILENT or tag in BOILERPLATE:
            if self.held[tag] > 0:
                self._end(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))
            else:
                self._break()

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """<![...> is a comment up to its first >, whatever it declares."""
        return self.rawdata.find(">", i + 3) + 1 or -1

    def whole(self, html: str) -> Lines:
        end = html.rfind(">") + 1  # no tag ends after it
        for i in range(0, end, FEED):
            self.feed(html[i : min(end, i + FEED)])
        rest, self.rawdata = self.rawdata, ""
        if rest.startswith("<") and not rest.startswith("<!--") and not self.cdata_elem:
            # A quote that never ends: without quotes every tag ends at its first >.
            self.feed(QUOTES.sub("", rest))
            rest, self.rawdata = self.rawdata, ""
        if not rest.startswith("<") and not self.cdata_elem:
            tail = rest + html[end:]
            opened = TAG.search(tail)
            self.handle_data(unescape(tail[: opened.start()] if opened else tail))
        self._break()
        return self


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    page = Lines().whole(html or "")
    lines = page.lines
    if not lines:
        return ""
    text, in_region = chosen_text(page, [x.of.level > 0 or x.of.spare for x in lines])
    if not in_region and any(x.of.spare and not x.of.level for x in lines):
        spare, _ = chosen_text(page, [x.of.level > 0 or not x.of.spare for x in lines])
        text = spare or text
    return text


def ratios(lines: list[Line], out: list[bool]) -> np.ndarray:
    """Text outside links over tags, under the priors of names: 0 for lines that are out, a part for those of suspect elements."""
    prior = [0.0 if gone else SUSPECT if x.of.suspect else 1.0 for x, gone in zip(lines, out)]
    return np.array([max(0, len(x.text) - x.linked) / (x.tags + 1) for x in lines]) * prior


def chosen_text(page: Lines, out: list[bool]) -> tuple[str, bool]:
    """The text of the region of the content lines, and whether it is in an article or main element."""
    lines = page.lines
    own = ratios(lines, out)
    smooth = smoothed(own)
    content = (own > 0) & (smooth >= min(smooth.std(), smooth.max()))
    if not content.any():
        return "", False
    region = core(page, content)
    inside = under(page.elements, region.number)
    within = [i for i, x in enumerate(lines) if inside[x.of.number]]
    told = {lines[i].of.suspect for i in within if content[i]}
    stays = [i for i in within if not out[i] and (not lines[i].of.suspect or lines[i].of.suspect in told)]
    if not region.region:
        stays = trimmed(page, stays, content, within)
    return "\n".join(lines[i].text for i in stays), region.region > 0


def core(page: Lines, content: np.ndarray) -> Open:
    """The innermost element that holds SHARE of the content lines' text; the article or main element that it is in, if it is in one."""
    elements = page.elements
    mass = [0] * len(elements)
    for i in np.flatnonzero(content).tolist():
        x = page.lines[i]
        mass[x.of.number] += max(1, len(x.text) - x.linked)
    holds = [False] * len(elements)
    for x in page.lines:
        holds[x.of.parent] = x.of.number > 0
    for x in reversed(elements[1:]):
        mass[x.parent] += mass[x.number]
        holds[x.parent] |= holds[x.number]
    at = elements[0]
    for x in elements[1:]:
        # An element that only holds text of its own is no region.
        if x.parent == at.number and mass[x.number] >= SHARE * mass[0] and holds[x.number]:
            at = x
    return elements[at.region] if at.region else at


def under(elements: list[Open], number: int) -> list[bool]:
    """Which elements are this one or lie in it."""
    inside = [False] * len(elements)
    inside[number] = True
    for x in elements[number + 1 :]:
        inside[x.number] = inside[x.parent]
    return inside


def trimmed(page: Lines, stays: list[int], content: np.ndarray, within: list[int]) -> list[int]:
    """The lines of a region that no article or main element marks: from cluster to cluster, and what stands beside them."""
    lines, elements = page.lines, page.elements

    def holder(x: Open) -> int:
        while x.tag in TEXTS:
            x = elements[x.parent]
        return x.number

    linked = [2 * x.linked >= len(x.text) for x in lines]
    known = [i for i in stays if content[i]]
    if not known:
        return []
    first, last, beside = known[0], known[-1], {holder(lines[i].of) for i in known}
    menus: set[int] = set()
    run: list[int] = []
    for i in [*stays, -1]:
        if i >= 0 and linked[i]:
            run.append(i)
        else:
            menus.update(run if len(run) >= MENU else ())
            run = []
    kept = []
    for i in stays:
        x = lines[i]
        if first <= i <= last:
            good = i not in menus
        else:
            good = not linked[i] and (x.of.tag in HEADINGS or x.of.tag in TEXTS and holder(x.of) in beside)
        if good:
            kept.append(i)
    above = [i for i in range(within[0]) if lines[i].of.tag in ("h1", "h2") and not lines[i].of.level and not lines[i].of.suspect and not lines[i].of.region]
    return above + kept


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return step

    columns = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")]
    return map_texts(df, columns, "html", "page_id long, url string, text string, n_chars long", make)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLE_SQL: dict[str, str] = {}
