"""Operator 4, HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of text.  Every line gets a weight, the lengths of WINDOW lines in a row
are summed, and the curve of the sums decides: text starts where a stretch of it surges and ends where it dives to zero.  A
stretch surges if its highest sum reaches SURGE, or the page's highest sum if that is less.  Lines between surge and dive
are kept.  Structure only weighs lines:

* Navigation, headers, footers, asides, forms, adverts, notices and reader comments weigh nothing and are never kept.
* Beside marked articles that hold at least as much text as the rest of the page, the rest weighs nothing.
* A line made mostly of links counts nothing, but within a marked article as any other line.
* A line of a container or marked article whose lines come to SURGE characters counts SURGE at least, so no short line of
  a long text is lost for what stands before it.
* Nothing-lines within a marked article are no lines at all; between articles beside each other lie WINDOW empty ones.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed elements end with their parents,
unclosed comments, scripts and styles with the page; a self-closing script, drawing or frame is empty; a tag whose quotes
never close ends at the next ">", and from there on quotes in tags mean nothing; without a ">" it is text; a reference
to a number beyond Unicode is U+FFFD; repeated rows are extracted row by row; an empty table gives an empty result; other
columns are ignored unless kept.  Whole pages are read, in time that grows with their length, and no text is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, quoted, tidied

WINDOW = 3
#: Characters in a window that mark a surge.
SURGE = 80

# The elements and names that matter.
RAW = frozenset("script style title textarea noscript iframe".split())
HIDDEN = frozenset("template select svg math canvas object audio video datalist head".split())
IN_HEAD = frozenset("meta link base script style title noscript template".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset label".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar widget widgets ad ads adv advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr popup popover modal overlay newsletter subscribe subscription "
    "pagination pager toolbar".split()
)
#: Names that a paragraph of an article may have as well as a box beside it.
VAGUE_NAMES = frozenset("menu aside banner notice notices notification alert signup signin login register share sharing social related recommended recommendations form search skip disclaimer copyright legal".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
HEADER_NAMES = frozenset("header topbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_ENDING = frozenset("li dt dd tr td th option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr img input label button".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre address summary".split()) | INLINE

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*+")
ATTRIBUTES = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([A-Za-z-]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
WORD = re.compile(r"[a-z0-9]+")
LONG_REFERENCE = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9A-Fa-f]{7,}+);?")


@dataclass
class Line:
    """A block of text; alive: not in what weighs nothing; linked: characters of links; article and container: 0 for none."""

    text: str
    alive: bool
    linked: int
    article: int
    container: int
    apart: bool = False  # of another article than the line before, neither within the other


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """'boiler', 'comment', 'article' or ''."""
    found, role, style = set(), "", ""
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "boiler"
        if name in ("class", "id"):
            found.update(WORD.findall(value))
        elif name == "role":
            role = value.strip()
        elif name == "style":
            style = value.replace(" ", "")
    if found & COMMENT_NAMES:
        return "comment"
    if tag in ("html", "body"):
        return ""
    if tag in BOILER_TAGS or role in BOILER_ROLES or "display:none" in style or found & BOILER_NAMES:
        return "boiler"
    if found & VAGUE_NAMES and not (in_article and tag in TEXT_BLOCKS):
        return "boiler"
    if (tag == "header" or found & HEADER_NAMES) and not in_article:
        return "boiler"
    return "article" if tag in ("article", "main") or role in ("main", "article") else ""


@dataclass(slots=True)
class _Open:
    """An open element: what holds within it."""

    tag: str = ""
    boiler: bool = False
    hidden: bool = False
    comment: bool = False
    article: int = 0
    container: int = 0


class _Tags:
    """(start, end, closing, name, attributes) of a page's tags, comments and declarations in order; name is '' for the last two."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self._next: dict[str, int] = {}

    def _find(self, what: str, at: int) -> int:
        """page.find, remembered, so that all searches together pass over the page once."""
        known = self._next.get(what, -2)
        if known != -1 and known < at:
            known = self._next[what] = self.page.find(what, at)
        return known

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where the element whose content begins at a place ends, closing tag included; the page's end if nowhere."""
        key = f"</{tag}"
        known = self._next.get(key, -2)
        if known != -1 and known < at:
            m = re.compile(rf"</{tag}(?![A-Za-z0-9:-])", re.I).search(self.page, at)
            known = self._next[key] = m.start() if m else -1
        end = self._find(">", known) if known >= 0 else -1
        return end + 1 if end >= 0 else len(self.page)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = self._find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if page.startswith(("<!", "<?"), start):
                end = self._find(">", start)
                if end >= 0:
                    return start, end + 1, False, "", ""
                continue
            closing = page.startswith("/", start + 1)
            m = NAME.match(page, start + 1 + closing)
            if not m:
                continue
            if self._find(">", m.end()) < 0:
                return None
            if self.quotes:
                if found := ATTRIBUTES.match(page, m.end()):
                    return start, found.end(), closing, m[0].lower(), found[0][:-1]
                # An open quote, or another "<" before the end.
                inner, end = page.find("<", m.end(), self._find(">", m.end())), self._find(">", m.end())
                if inner >= 0:
                    continue
                self.quotes = False
            end = self._find(">", m.end())
            return start, end + 1, closing, m[0].lower(), page[m.end() : end]
        return None


def lines_of(page: str) -> list[Line]:
    """The blocks of text of a page, in page order."""
    tags, lines, parts = _Tags(page), [], []
    stack, places = [_Open()], {}  # places: where the open elements of each name are in the stack
    open_articles: set[int] = set()
    made = linked = 0
    in_link, last_article, state = False, 0, stack[0]

    def end_line() -> None:
        nonlocal linked, last_article
        if parts:
            text = " ".join(html.unescape(LONG_REFERENCE.sub("\N{REPLACEMENT CHARACTER}", "".join(parts))).split())
            if text:
                alive = not state.boiler
                apart = bool(alive and last_article and state.article > last_article and last_article not in open_articles)
                lines.append(Line(text, alive, min(linked, len(text)), state.article, state.container, apart))
                last_article = state.article if alive else last_article
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, state
        if stack[-1].hidden:
            return
        if (state.boiler, state.article) != (stack[-1].boiler, stack[-1].article):
            end_line()
        state = stack[-1]
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.article != stack[-1].article:
                open_articles.discard(gone.article)

    at = 0
    while found := tags.after(at):
        start, end, closing, tag, attributes = found
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            end_line()
        if closing:
            if places.get(tag):
                close_to(places[tag][-1])
            in_link = in_link and tag != "a"
            continue
        if places.get("head") and tag not in IN_HEAD:
            close_to(places["head"][-1])
        empty = attributes.rstrip().endswith("/")
        if tag in RAW:
            at = at if empty else tags.end_of_raw(tag, at)
            continue
        if tag in VOID or empty and tag in HIDDEN:
            continue
        if len(stack) > 1 and (stack[-1].tag == "p" and tag not in INLINE or stack[-1].tag == tag and tag in SELF_ENDING):
            close_to(len(stack) - 1)
        in_link = in_link or tag == "a"
        outer = stack[-1]
        kind = _kind(tag, attributes, bool(outer.article))
        now = _Open(tag, outer.boiler, outer.hidden or tag in HIDDEN, outer.comment, outer.article, outer.container)
        if kind == "article" and not outer.comment:
            made += 1
            now.boiler, now.article, now.container = False, made, made
            open_articles.add(made)
        elif kind:
            now.boiler, now.comment = True, outer.comment or kind == "comment"
        elif tag not in TEXT_BLOCKS:
            made += 1
            now.container = made
        places.setdefault(tag, []).append(len(stack))
        stack.append(now)
    if at < len(page):
        add(page[at:])
    end_line()
    return lines


def weighed(lines: list[Line]) -> list[tuple[int, int]]:
    """(place of the line, or -1 for one that weighs nothing; its count) of each line that the windows pass over."""
    inside = sum(len(x.text) for x in lines if x.alive and x.article)
    outside = sum(len(x.text) - x.linked for x in lines if x.alive and not x.article)
    marked = inside > 0 and inside >= outside
    running: dict[int, int] = {}
    for x in lines:
        if x.alive:
            running[x.container] = running.get(x.container, 0) + len(x.text) - (0 if x.article else x.linked)
    out, near = [], False  # near: the last line that is alive is of a marked article
    for i, x in enumerate(lines):
        count, here = 0, x.alive and bool(x.article or not marked)
        if here:
            free = len(x.text) - (0 if x.article else x.linked)
            long_run = running[x.container] >= SURGE and (x.container or free * 2 > len(x.text))
            count = max(free if free * 2 > len(x.text) else 0, SURGE if long_run else 0)
        if marked and x.apart:
            out += [(-1, 0)] * WINDOW
        if count or not (marked and near and not x.alive and x.article):
            out.append((i if here else -1, count))
        near = bool(x.article) if x.alive else near
    return out


def stretches(counts: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """[start, end) of each stretch of lines whose window sums (each of a line and those after it) rise to the surge and dive to zero."""
    sums, total = [], 0
    for i in range(len(counts) - 1, -1, -1):
        total += counts[i] - (counts[i + window] if i + window < len(counts) else 0)
        sums.append(total)
    sums.reverse()
    least = max(1, min(surge, max(sums, default=0)))
    found, start, peak = [], 0, 0
    for i, s in enumerate([*sums, 0]):
        if s:
            start = start if peak else i
            peak = max(peak, s)
        elif peak:
            if peak >= least:
                found.append((start, i))
            peak = 0
    return found


def main_text(page: str | None, *, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text: its blocks between surges and dives of the line-block distribution, joined by spaces."""
    lines = lines_of(page or "")
    placed = weighed(lines)
    kept = []
    for a, b in stretches([c for _, c in placed], window, surge):
        full = [i for i in range(a, b) if placed[i][1]]
        kept += [placed[i][0] for i in range(full[0], full[-1] + 1) if placed[i][0] >= 0]
    return " ".join(lines[i].text for i in kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns in keep, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*part.schema.names[1:], "text", "n_chars"])

    kept = [id_col, *keep]
    schema = ", ".join(f"{quoted(c)} {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(F.col(quoted(html_col)).cast("string").alias("html"), *[F.col(quoted(c)) for c in kept]).mapInArrow(tidied(run), f"{schema}, text string, n_chars long")
