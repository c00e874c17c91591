"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block. Each line weighs its characters outside of links, or nothing if most of them
are links, and weights are summed over a sliding window of lines: the text surges where a window rises above ``surge``
characters and dives where one falls to ``dive``. On a page of little text both are lower, in proportion to its fullest
window. Lines between a surge and its dive are kept, but for short ones at either end that are no headings or sentences.
Lines outside that belong to a kept run stay with it: what stands between two of its lines in one container, sentences
and headings of the same container, and paragraphs of the container or list items that follow it, behind a gap, too.

Where one container holds more than half of the weight of all lines, what the windows keep outside of it stays only in
stretches that are fuller than ``surge``, and than ``BESIDE`` of what they keep inside. That needs no name of a tag or class.

Markup supports the windows. All lines of the article that holds most text are kept, and of those beside it in the same
container, or of at least ``LIKE`` times its characters a line, unless they are mostly links; if the runs outside hold
more text than these, and at least ``BULK`` characters, the windows alone decide. Elements that never hold it (menus, footers,
adverts, forms, scripts and the like, by tag, role, or a word of the class or id) leave a gap of empty lines, but a word
is overruled if its element holds more than half of the page's text outside of links and at least ``BULK`` characters.
Attributes of inline and void elements hide nothing, nor do ids of an article's sections and of headings, paragraphs and
list items; of these only a whole class name counts, and of headings none.

Comments, scripts, styles, drawings, frames, media and templates are no text; formulas and what an object holds are.
Of these, elements that are self-closed or never closed hide nothing behind them.

A null page is empty, a page without text gives the empty text, unclosed tags end with their parent, and an undecodable
character reference stays as it is written. Repeated rows stay separate. Only the named columns are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE, DIVE = 120, 30
BULK = 500
LIKE = 0.5
BESIDE = 0.1
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>")
INSIDE_TAG = r"(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^>])*+)>"
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe|textarea|title)" + INSIDE_TAG + r"|<![^>]*>|<\?[^>]*>", re.S | re.I)  # what they hold is no markup
RAW_END = re.compile(r"</(script|style|noscript|iframe|textarea|title)\s*>", re.I)
UNREAD = re.compile(r"<(/?)(svg|template|canvas|audio|video)" + INSIDE_TAG, re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside form button select menu dialog head".split())
OUTSIDE = frozenset(["header"])  # not article text, unless it heads the article itself
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar side widget menu navigation navbar nav breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus share sharing social related recommended pagination pager login signup search".split()
)
HEADED = frozenset("header masthead topbar toolbar".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[^\s]")
KEPT_ROOTS = frozenset(["html", "body", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre".split())
ITEMS = frozenset("li dt dd td th".split())
CONTAINERS = BLOCKS - HEADINGS - PARAGRAPHS - {"hr"}
UNCLOSED = frozenset("li dt dd tr td th".split())  # the next of them ends one
SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f\u0964\u061f][\"'\u201d\u2019\u00bb)\]]*\Z")


class Line(NamedTuple):
    text: str
    article: int  # which of the page's top-level article elements, 0 outside of them
    linked: int = 0  # characters in links
    place: int = 0  # container that holds the line's block
    tag: str = ""  # that block
    parent: int = 0  # container that holds the article

    @property
    def weight(self) -> int:
        return 0 if 2 * self.linked > len(self.text) else len(self.text) - self.linked

    @property
    def prose(self) -> bool:
        return self.tag in HEADINGS or (self.tag in PARAGRAPHS and bool(SENTENCE.search(self.text)))


def _pairs(attributes: str) -> Iterator[tuple[str, str]]:
    """Whole name=value pairs in lower case, from the start of the string; the first of a name counts."""
    seen = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name and name not in seen:
            seen.add(name)
            yield name, "".join(values).lower()


def _boilerplate(tag: str, attributes: str, inside: bool) -> str:
    """"never" by tag, role or visibility, "hint" by a word of the class or id, else empty."""
    if tag in NEVER or (tag in OUTSIDE and not inside):
        return "never"
    if not attributes or tag in KEPT_ROOTS or tag not in BLOCKS:
        return ""
    hint = ""
    for name, value in _pairs(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "never"
        if name == "role" and value in ROLES:
            return "never"
        if tag in CONTAINERS - ITEMS:
            words = set(re.split(r"[^a-z]+", value)) if name == "class" or (name == "id" and not (inside and tag == "section")) else set()
        else:  # of a paragraph or list item only whole class names count, of a heading none
            words = set(value.split()) if name == "class" and tag not in HEADINGS else set()
        if words & WORDS or (not inside and words & HEADED):
            hint = "hint"
    return hint


def _without(page: str, cuts: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in cuts:
        parts += [page[at:start], " "]
        at = end
    return "".join(parts) + page[at:]


def read_part(page: str) -> str:
    """The page without comments, scripts, drawings and the like. Of these elements a self-closed one is empty; one
    without an end is, too, but for the text before the next tag where it holds no markup."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in reversed(list(RAW_END.finditer(page))):
        ends.setdefault(m[1].lower(), []).append(m.span())
    cuts, at = [], 0
    while m := RAW.search(page, at):
        start, at = m.span()
        if m[1] and not m[2].endswith("/"):
            left = ends.get(m[1].lower(), [])
            while left and left[-1][0] < at:
                left.pop()
            if left:
                at = left[-1][1]
            else:
                tag = TAG.search(page, at)
                at = tag.start() if tag else len(page)
        cuts.append((start, at))
    page = _without(page, cuts)
    opened: dict[str, list[tuple[int, int]]] = {}
    whole: list[tuple[int, int]] = []
    for m in UNREAD.finditer(page):
        mine = opened.setdefault(m[2].lower(), [])
        if m[1]:
            whole.append((mine.pop()[0] if mine else m.start(), m.end()))
        elif m[3].endswith("/"):
            whole.append(m.span())
        else:
            mine.append(m.span())
    cuts, at = [], 0
    for start, end in sorted(whole + [span for mine in opened.values() for span in mine]):
        if end > at:  # not inside of the one before
            cuts.append((max(start, at), end))
            at = end
    return _without(page, cuts)


def _size(text: str) -> int:
    return len(" ".join(references.unescape(text).split()))


def page_lines(page: str, parents: list[int] | None = None) -> list[Line]:
    """Lines in page order; an empty one stands for a gap. ``parents`` gets the container around each, by number."""
    parents = [] if parents is None else parents
    parents[:] = [-1]
    page = read_part(page)
    tags = [(m.start(), m.end(), bool(m[1]), m[2].lower(), m[3]) for m in TAG.finditer(page, 0, page.rfind(">") + 1)]
    linking, since = [False] * (len(tags) + 1), None  # by tag: whether the text behind it is in a link
    for k, (_, _, closing, tag, attributes) in enumerate(tags):
        if tag == "a":
            if closing and since is not None:  # a link without an end is none
                linking[since:k] = [True] * (k - since)
            since = None if closing or all(name != "href" for name, _ in _pairs(attributes)) else k
    outside = [0]  # characters outside of links before each tag
    for k in range(len(tags)):
        behind = page[tags[k][1] : tags[k + 1][0] if k + 1 < len(tags) else len(page)]
        outside.append(outside[-1] + (0 if linking[k] else len(behind.strip())))
    ends: dict[int, int] = {}  # the closing tag of each element that has one
    started: dict[str, list[int]] = {}
    for k, (_, _, closing, tag, attributes) in enumerate(tags):
        if closing and started.get(tag):
            ends[started[tag].pop()] = k
        elif not closing and not attributes.endswith("/"):
            started.setdefault(tag, []).append(k)
    lines: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, container, the one around it
    open_: dict[str, int] = {}  # containers on the stack, by tag
    at = k = number = depth = linked = places = parent = 0
    block = ""

    def end_line() -> None:
        nonlocal linked
        line = " ".join(references.unescape("".join(text)).split())
        if line:
            tag, place, around = stack[-1]
            lines.append(Line(line, number if depth else 0, linked, place if block else around, block or tag, parent))
        text.clear()
        linked = 0

    while k < len(tags):
        start, end, closing, tag, attributes = tags[k]
        text.append(page[at:start])
        if k and linking[k - 1]:
            linked += _size(text[-1])
        at, k = end, k + 1
        if tag == "br":
            text.append(" ")
            continue
        why = "" if closing or attributes.endswith("/") else _boilerplate(tag, attributes, depth > 0)
        j = ends.get(k - 1, -1)
        if why == "hint" and j >= 0:
            held = outside[j] - outside[k - 1]
            if held >= BULK and 2 * held > outside[-1]:
                why = ""
        if tag in BLOCKS or why:
            end_line()
            block = tag if not closing and tag not in CONTAINERS else ""
        if why:
            block = ""
            if j >= 0:  # an element without an end hides nothing but what comes before the next tag
                at, k = tags[j][1], j + 1
            elif k < len(tags):
                at = tags[k][0]
            lines += [Line("", number if depth else 0)] * WINDOW
            continue
        if tag in ("article", "main"):
            if not closing:
                if not depth:
                    number, parent = number + 1, stack[-1][1]
                depth += 1
            else:
                depth = max(0, depth - 1)
            lines += [Line("", number if depth else 0)]
        if tag in CONTAINERS and closing and open_.get(tag):
            while True:
                name = stack.pop()[0]
                open_[name] -= 1
                if name == tag:
                    break
        elif tag in CONTAINERS and not closing and not attributes.endswith("/"):
            if tag in UNCLOSED and stack[-1][0] == tag:
                open_[stack.pop()[0]] -= 1
            places += 1
            parents.append(stack[-1][1])
            stack.append((tag, places, stack[-1][1]))
            open_[tag] = open_.get(tag, 0) + 1
    text.append(page[at:])
    end_line()
    return lines


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sums over each line and those behind it."""
    sums, now = [], 0
    for i in range(len(weights) - 1, -1, -1):
        now += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums.append(now)
    return sums[::-1]


def runs(lengths: list[int], window: int = WINDOW, surge: float = 0, dive: float = 0) -> list[tuple[int, int]]:
    """[from, to) of the lines between each surge (a window's sum rises above ``surge``) and dive (one of ``dive`` or less)."""
    found, start = [], None
    for i, s in enumerate(window_sums(lengths, window)):
        if start is None and s > surge:
            start = i
        elif start is not None and s <= dive:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def main_container(lines: list[Line], parents: list[int], weights: list[int]) -> list[bool]:
    """Of every container, whether it is the innermost one with more than half of all weight, or inside of that."""
    held = [0] * len(parents)
    for line, w in zip(lines, weights):
        held[line.place] += w
    total = sum(held)
    for place in range(len(parents) - 1, 0, -1):  # containers are numbered as they open
        held[parents[place]] += held[place]
    main = max(place for place, w in enumerate(held) if 2 * w > total or place == 0)
    inside = [False] * len(parents)
    for place in range(len(parents)):
        inside[place] = place == main or (place > 0 and inside[parents[place]])
    return inside


def text_lines(lines: list[Line], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE, parents: list[int] | None = None) -> list[int]:
    """Places in ``lines`` of those that the window sums keep, and of those that belong to them.

    Where one container holds more than half of the page's weight, lines outside of it stay only in stretches that are
    themselves fuller than ``surge`` and than ``BESIDE`` of what is kept inside; so a short notice beside the text goes,
    whatever it is called.
    """
    weights = [line.weight for line in lines]
    if not any(weights):  # nothing but links
        weights = [len(line.text) for line in lines]
    most = max(window_sums(weights, window), default=0)
    bulk = surge
    surge = min(surge, most / 2)
    dive = min(dive, surge / 4)
    least = surge / window
    solid = [w > least or (w > 0 and line.prose) for w, line in zip(weights, lines)]
    kept = [False] * len(lines)
    ends: dict[int, tuple[int, int]] = {}
    for a, b in runs(weights, window, surge, dive):
        sure = [i for i in range(a, b) if solid[i]]
        for i in range(sure[0], sure[-1] + 1) if sure else ():
            kept[i] = True
        for i in sure:
            place = lines[i].place
            ends[place] = (ends.get(place, (i, i))[0], i)
    inner = [0] * (len(lines) + 1)
    for first, last in ends.values():
        inner[first] += 1
        inner[last + 1] -= 1
    depth, behind = 0, False
    for i, line in enumerate(lines):
        depth += inner[i]
        if not line.text:  # a gap parts nothing
            continue
        held = line.place in ends
        follows = behind and (line.tag in ITEMS or (held and not line.linked and (line.tag in PARAGRAPHS or bool(SENTENCE.search(line.text)))))
        kept[i] = kept[i] or (weights[i] > 0 and (depth > 0 or follows or (line.prose and held)))
        behind = kept[i]
    if parents is not None and len(parents) > 1:
        inside = main_container(lines, parents, weights)
        least = max(bulk, BESIDE * sum(w for line, w, k in zip(lines, weights, kept) if k and inside[line.place]))
        stretch: list[int] = []
        for i in range(len(lines) + 1):
            if i < len(lines) and (not lines[i].text or not inside[lines[i].place]):
                stretch.append(i)
                continue
            if sum(weights[j] for j in stretch if kept[j]) < least:
                for j in stretch:
                    kept[j] = False
            stretch = []
    return [i for i, line in enumerate(lines) if kept[i] and line.text]


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> str:
    parents: list[int] = []
    lines = page_lines(page or "", parents)
    articles: dict[int, list[Line]] = {}
    for line in lines:
        if line.article and line.text:
            articles.setdefault(line.article, []).append(line)
    spread = text_lines(lines, window, surge, dive, parents)
    if articles:
        weight = {a: sum(len(line.text) - line.linked for line in own) for a, own in articles.items()}
        best = max(articles, key=lambda a: (weight[a], sum(len(line.text) for line in articles[a]), -a))
        density = {a: weight[a] / len(own) for a, own in articles.items()}
        near = {a for a, own in articles.items() if own[0].parent == articles[best][0].parent or density[a] >= LIKE * density[best]}
        chosen = {a for a in near if 2 * weight[a] > sum(len(line.text) for line in articles[a])} | {best}
        others = sum(lines[i].weight for i in spread if not lines[i].article)
        if others < BULK or others <= sum(weight[a] for a in chosen):
            return "\n".join(line.text for line in lines if line.article in chosen and line.text)
    return "\n".join(lines[i].text for i in spread)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            some = batch.slice(k, 500)
            texts = [main_text(page) for page in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Pages stay where they are; nothing is shuffled."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
