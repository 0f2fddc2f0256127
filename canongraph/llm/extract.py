"""Operator 6. Main text of web pages.

Method: the standard library's streaming parser turns a page into lines (blocks of text). Each line has a text-to-tag
ratio: its characters outside links over the tags in it. A Gaussian smooths the ratios along the page, and clustering
them in two groups gives the threshold above which a line belongs to a content region; a region takes in the few short lines
between its lines and the headings right before them. What the markup itself says goes in as evidence before clustering:
lines inside ``article`` or ``main`` gain by the share of the text there (as much as a ratio of 20 at most), lines of menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are out.

Null or empty html gives an empty text, and an empty table an empty result. Repeated rows and page_ids give a row each, and a
null page_id or url stays null. Pages of any length are parsed whole; broken nesting and pages that end early are read as far
as they go. Ratios that tie with the threshold are in. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, tidy

#: Elements that part blocks.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
OUT = frozenset("head title nav header footer aside form script style noscript template iframe object svg math button select textarea dialog menu canvas audio video map datalist search".split())
#: Of those, the ones that a page may forget to close before its article.
LEFT_OPEN = frozenset("nav header footer menu".split())
#: Words of class, id or role that mark what is not main text: by themselves, or with no words but each other and NEUTRAL ones.
OUT_WORDS = frozenset("advert adverts advertisement advertising adsense breadcrumb breadcrumbs commentlist complementary consent contentinfo cookie cookies disqus masthead menubar modal nav navbar navigation newsletter pagination popup popups promo sidebar sidenav skyscraper sponsored subscribe toolbar".split())
WITH_OTHERS = frozenset("ad ads adv banner comment comments dialog disclaimer footer header menu notice notices promotion promotions related search share sharing social sponsor subscription widget".split())
NEUTRAL = frozenset("area article articles bar block body bottom box btn button buttons container content form global group has icon icons inner is item items js left line links list main media page pages panel post posts reader right row section sections site slot text thread title top unit user users wrap wrapper".split())
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ending tags that a start tag of the key implies, within the same parent.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Weights of the evidence, in units of the natural log of the ratio.
INSIDE, WIDTH = 3.0, 1.0
#: Short lines in a row that a region takes in.
GAP = 3


def _marks_out(name: str) -> bool:
    words = {w.lower() for w in _TOKEN.findall(name)}
    if not OUT_WORDS.isdisjoint(words):
        return True
    return not WITH_OTHERS.isdisjoint(words) and all(w in WITH_OTHERS or w in NEUTRAL or len(w) == 1 for w in words)


def _is_out(tag: str, attrs) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role"):
            # a page's or article's own wrapper may carry such words; only lesser elements are judged by them
            if value and tag not in ("html", "body", "main") and any(map(_marks_out, value.split())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool]] = []  # text, tags, characters in links, inside article or main, heading
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.stack: list[tuple[str, str, bool, bool]] = []  # tag, what put it out, inside, link
        self.open: dict[str, int] = {}  # how often each tag is on the stack
        self.out, self.inside, self.link = "", False, False

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = any(x[0] in HEADINGS for x in self.stack[-3:])
                self.lines.append((text, self.tags, self.linked, self.inside, heading))
            self.parts = []
        self.tags = self.linked = 0

    def pop_to(self, tag: str) -> None:
        stack = self.stack
        while stack:
            top, self.out, self.inside, self.link = stack.pop()
            self.open[top] -= 1
            if top == tag:
                return

    def parse_marked_section(self, i, report=1):
        # as browsers do; the parser's own reading stops at malformed ones
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            stack = self.stack
            if tag in _CLOSE_P and self.open.get("p"):
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t == "p":
                        # formatting left open in the paragraph ends with it
                        del_from = stack[i]
                        for gone in stack[i:]:
                            self.open[gone[0]] -= 1
                        del stack[i:]
                        _, self.out, self.inside, self.link = del_from
                        break
                    if t in BLOCKS:
                        break
            elif tag in _CLOSES:
                if stack and stack[-1][0] in _CLOSES[tag]:
                    gone, self.out, self.inside, self.link = stack.pop()
                    self.open[gone] -= 1
        self.tags += 1
        if tag in VOID:
            return
        self.stack.append((tag, self.out, self.inside, self.link))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "article" or tag == "main":
            self.inside = True
            if self.out in LEFT_OPEN:
                self.out = ""
        if not self.out:
            self.out = tag if tag in OUT else "marked" if attrs and _is_out(tag, attrs) else ""
        if tag == "a":
            self.link = True

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.open.get(tag):
            return  # closes nothing
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(tag)
                break
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                break

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def lines_of(html: str):
    p = _Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p.lines


_KERNEL = [math.exp(-(i * i) / (2 * WIDTH * WIDTH)) for i in range(-2, 3)]


def smooth(x: list[float]) -> list[float]:
    out, n = [], len(x)
    for i in range(n):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < n:
                total += _KERNEL[d + 2] * x[i + d]
                weight += _KERNEL[d + 2]
        out.append(total / weight)
    return out


def threshold(x: list[float]) -> float:
    """Where two clusters of values part (two means, from the extremes); below all of them if they are alike."""
    low, high = min(x), max(x)
    if high - low < 0.7:  # less than a factor of two between the ratios: one region
        return low
    for _ in range(30):
        at = (low + high) / 2
        a, b = [v for v in x if v < at], [v for v in x if v >= at]
        new = (sum(a) / len(a) if a else low, sum(b) / len(b))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def filled(chosen: list[bool], lines) -> list[bool]:
    """With the lines of a region that are too short by themselves: up to GAP between two chosen ones, and headings before one."""
    out, last = list(chosen), None
    for i, line in enumerate(lines):
        if not chosen[i]:
            continue
        if last is not None and i - last - 1 <= GAP and all(2 * x[2] < len(x[0]) and x[3] == line[3] for x in lines[last + 1 : i]):
            out[last + 1 : i] = [True] * (i - last - 1)
        k = i - 1
        while k >= 0 and not out[k] and lines[k][4] and lines[k][2] == 0:
            out[k] = True
            k -= 1
        last = i
    return out


def main_text(html: str | None, smoothed: bool = True, inside: float = INSIDE) -> str:
    """``smoothed``: False leaves the Gaussian out; ``inside``: the weight of the markup's own word. To see what they do."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    ratio = [math.log1p(max(0, len(t) - linked) / max(1, tags)) for t, tags, linked, _, _ in lines]
    ratio = smooth(ratio) if smoothed else ratio
    own = [max(0, len(t) - linked) for t, _, linked, _, _ in lines]
    within = sum(n for n, line in zip(own, lines) if line[3])
    # the markup counts by the share of the text that it names
    gain = inside * within / max(1, sum(own))
    score = [r + (gain if line[3] else 0.0) for r, line in zip(ratio, lines)]
    # where it names some, an empty line stands for what is outside: short lines of an article alone are not the other cluster
    at = threshold([*score, 0.0] if within else score)
    return " ".join(line[0] for x, line in zip(filled([s >= at for s in score], lines), lines) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; n_chars counts code points."""

    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
