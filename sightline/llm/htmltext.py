"""Main text of HTML pages by text-to-tag ratio.

Events of the standard-library parser are cut into lines, one for each block of text. A line's
ratio is its characters by its tags. The ratios of a page are smoothed by a Gaussian over
neighbouring lines and clustered in two: one centre stays at zero, the other moves as in k-means, and
lines above the threshold between them are the seeds of content. Lines stand in regions, the elements that hold them; a region with a seed is content as a
whole, so headings and short paragraphs of it stay. Where a page marks its article or main part,
only such regions are.

Furniture is suspected by element, or by a name in class, id or role, and dropped. A suspicion that
rests on a name or on a form falls if the suspect holds an article or main part, or if
the text outside all suspects is no more than a fifth of its own; menus, asides, footers and page
headers stay dropped. A named inline element is furniture only if its line has no other text.

Nothing else is dropped, and nothing is cut off. Defined results: null, empty and text-free pages
give ""; text outside any tag counts as a block; very long pages are taken whole; repeated rows keep
their rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import map_arrow

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video map select textarea button datalist dialog".split())
FURNITURE = frozenset("nav footer aside form menu search fieldset".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd".split())
#: Elements whose end tag may be left out, and the open ones that their start closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
# Words of class, id and role that page furniture goes by.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars footer footers colophon masthead "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist discussion disqus respond replies reply share sharing social related recommended recommendations widget widgets search form "
    "complementary contentinfo dialog skip".split()
)
HEAD_NAMES = frozenset("header siteheader pageheader".split())
# First words of class names that say what a page has or is about, not what an element is.
ABOUT = frozenset("has no with without is not tag category cat format type status page post term author".split())
#: Elements whose suspicion can fall.
SOFT = frozenset("form fieldset search".split())
_WORD = re.compile(r"[a-z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

Line = tuple[str, int, int, tuple[int, ...]]  # text, tags, region, suspects around it


def unseen(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in HIDDEN or any(k in ("hidden", "inert") or k == "aria-hidden" and v == "true" or k == "style" and v and _UNSEEN.search(v.lower()) for k, v in attrs)


def named(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether a name in class, id or role is one of furniture; ``inside``: an article or main part."""
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for name in v.lower().split():
                words = _WORD.findall(name)
                if not words or len(words) > 1 and (tag == "article" or words[0] in ABOUT):
                    continue
                if NAMES.intersection(words) or not inside and tag != "article" and HEAD_NAMES.intersection(words):
                    return True
    return False


class Events(HTMLParser):
    """Lines of a page with their tags, regions and suspects."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = ["page"]  # of each region: page, box, main, article
        self.soft: list[bool] = []  # of each suspect: its suspicion can fall
        self.marked: set[int] = set()  # suspects that hold an article or main part
        self.text: list[tuple[str, bool]] = []  # and whether it stands in a named inline element
        self.tags = 0
        #: (tag, is not seen, region, suspects) of open elements
        self.open: list[tuple[str, bool, int, tuple[int, ...]]] = [("", False, 0, ())]
        self.depth: dict[str, int] = {}
        self.inline: list[tuple[str, int]] = []  # a named inline element and those in it, with their depth

    def cut(self) -> None:
        """End the line."""
        if self.text:
            line = " ".join("".join(t for t, _ in self.text).split())
            if line:
                _, _, region, suspects = self.open[-1]
                if all(aside for t, aside in self.text if not t.isspace()):
                    suspects = (*suspects, self.suspect(True))
                self.lines.append((line, self.tags, region, suspects))
                self.tags = 0
            self.text = []

    def suspect(self, soft: bool) -> int:
        self.soft.append(soft)
        return len(self.soft) - 1

    def last(self, tag: str) -> int:
        return next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.depth[self.open.pop()[0]] -= 1
        while self.inline and self.inline[-1][1] > at:
            self.inline.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append((" ", True))
            return
        _, hidden, region, suspects = self.open[-1]
        inside = self.kinds[region] in ("article", "main")
        if tag in INLINE:
            if tag not in VOID and not hidden:
                if unseen(tag, attrs):
                    self.cut()
                    self.push(tag, True, region, suspects)
                elif self.inline or named(tag, attrs, inside):
                    self.inline.append((tag, len(self.open)))
            return
        self.cut()
        if tag in VOID:
            return
        if self.depth.get("p") and tag not in HIDDEN:  # a block ends an open paragraph
            self.end_of("p")
        for other in CLOSES.get(tag, ()):
            if self.depth.get(other):
                at = self.last(other)
                if not any(o[0] in ("ul", "ol", "dl", "table", "select") for o in self.open[at + 1 :]):
                    self.pop_to(at)
        _, hidden, region, suspects = self.open[-1]
        inside = self.kinds[region] in ("article", "main")
        hidden = hidden or unseen(tag, attrs)
        role = next((v for k, v in attrs if k == "role"), None)
        kind = "article" if tag == "article" or role == "article" else "main" if tag == "main" or role == "main" else "box" if tag not in LEAVES else None
        if not hidden:
            if tag in FURNITURE or tag == "header" and not inside:
                suspects = (*suspects, self.suspect(tag in SOFT))
            elif tag not in ("html", "body", "main") and named(tag, attrs, inside):
                suspects = (*suspects, self.suspect(True))
            elif kind in ("article", "main"):
                self.marked.update(suspects)
            if kind and (kind == "article" and self.kinds[region] != "article" or kind != "article" and self.kinds[region] in ("page", "box")):
                if tag not in ("html", "body") or kind != "box":
                    self.kinds.append(kind)
                    region = len(self.kinds) - 1
        self.push(tag, hidden, region, suspects)

    def push(self, tag: str, hidden: bool, region: int, suspects: tuple[int, ...]) -> None:
        self.open.append((tag, hidden, region, suspects))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def end_of(self, tag: str) -> None:
        if self.depth.get(tag):
            self.cut()
            self.pop_to(self.last(tag))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE:
            if self.open[-1][0] == tag:
                self.end_of(tag)
            elif self.inline and self.inline[-1][0] == tag:
                self.inline.pop()
            return
        self.cut()
        self.end_of(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.text.append((data, bool(self.inline)))


def lines_of(html: str) -> tuple[list[Line], list[str]]:
    """The lines that are no furniture, and the kinds of regions."""
    events = Events()
    events.feed(html)
    events.close()
    events.cut()
    held, free = [0] * len(events.soft), 0
    for text, _, _, suspects in events.lines:
        free += 0 if suspects else len(text)
        for x in suspects:
            held[x] += len(text)
    falls = [soft and (x in events.marked or 5 * free <= held[x]) for x, soft in enumerate(events.soft)]
    return [line for line in events.lines if all(falls[x] for x in line[3])], events.kinds


def gaussian(radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines; weights beyond the page's ends are left out."""
    w = gaussian()
    pad = len(w) // 2
    mass = np.convolve(np.pad(np.ones(len(ratios)), pad), w, "valid")
    return np.convolve(np.pad(ratios, pad), w, "valid") / mass


def seeds(ratios: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Lines nearer to the centre of the content, which moves as in k-means, than to the one that stays at zero."""
    threshold = ratios.mean() / 2
    for _ in range(rounds):
        moved = ratios[ratios >= threshold].mean() / 2
        if moved == threshold:
            break
        threshold = moved
    return ratios >= threshold


def main_text(html: str | None) -> str:
    """Blocks of the content regions in page order, joined by one space."""
    lines, kinds = lines_of(html or "")
    if not lines:
        return ""
    found = seeds(smoothed(np.array([len(t) / max(1, tags) for t, tags, _, _ in lines])))
    seeded = {line[2] for line, s in zip(lines, found, strict=True) if s}
    held = {line[2] for line in lines}
    for kind in ("article", "main"):
        marked = {r for r in held if kinds[r] == kind}
        if marked:
            chosen = marked & seeded or marked
            break
    else:
        chosen = seeded or held
    return " ".join(t for t, _, r, _ in lines if r in chosen)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars); one row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long", rows=500)
