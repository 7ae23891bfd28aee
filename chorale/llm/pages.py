"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one per block element). A line weighs its characters less those in links. Over the weights runs a sliding window of
`WINDOW` lines; text surges where a window's sum reaches a threshold and dives where none does. The threshold is `SHARE` of the page's own
level, the window sum at which half of the page's text lies, but at most `DENSE` characters. So link menus, cookie bars, adverts and the like go
by their density, whatever their class.

Tags and classes are weights: a line in a class or id of `MARKED` (less of one that also names real content, `NAMES`), or outside the marked article of a page that has one, weighs a fraction and must
be dense among lines of its own kind; navigation, forms, headers, footers, dialogs and hidden elements weigh nothing; in a marked article
any text outside links is enough. At the ends of a region lines of another container go, if that part is not dense by itself and
is neither a heading nor inside the container of a dense part (a notice beside the text); between dense parts of one container all text
stays. Boilerplate as long and as free of links as the text is beyond this method, if no tag or class tells it.

Character references are decoded, white space in a block becomes one space, blocks are joined by one newline. Null or empty html, or a
page without text outside links: empty text. Truncated markup is read to its end. Rows are independent, so repeated rows give equal results.
"""
from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SHARE, DENSE = 0.25, 200
#: Weight of lines in a marked class, of those whose class also names real content, and of lines outside the article; least window sum of all these.
MARK, DOUBTFUL, OUTSIDE, FLOOR = 1 / 32, 1 / 8, 1 / 4, 25
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form head title button dialog menu label".split())
MARKED = re.compile(r"(?:^|[\s_-])(ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|respond|replies|reply|disqus|pagination|pager|tags|toolbar|widget|disclaimer|copyright|legal|skip)(?:$|[\s_\d-])", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset("tags legal related recommended notice notices alert header banner overlay modal widget disclaimer copyright promotion share sharing social".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of the block around them, not containers of their own.
PARTS = frozenset("li dd dt tr td th tbody thead tfoot".split())
SPACE = re.compile(r"\s+")


class Place(NamedTuple):
    """What holds inside an open element."""
    block: str = ""  # innermost block
    around: int = 0  # nearest container around that block
    home: int = 0  # that block, or the container that it is part of
    marked: int = 0
    weight: float = 1.0


class Line(NamedTuple):
    text: str
    own: int  # characters outside links
    nothing: bool  # in an element that weighs nothing
    marked: int  # number of the outermost marked element around it, 0 for none
    weight: float  # the least weight of the elements around it
    article: bool
    heading: bool
    around: int  # the nearest container around its block, 0 for none


def weight_of(tag: str, attributes: str, in_article: bool) -> float:
    if tag in ASIDE or (tag == "header" and not in_article):
        return 0.0
    if not attributes or tag in ("html", "body", "article", "main"):
        return 1.0
    weight = 1.0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return 0.0
        if name in ("class", "id") and MARKED.search(value):
            weight = min(weight, DOUBTFUL if all(m.lower() in NAMES for m in MARKED.findall(value)) else MARK)
    return weight


def lines_of(page: str) -> tuple[list[Line], dict[int, int]]:
    """The lines, and the next container around each container."""
    lines: list[Line] = []
    held: list[tuple[str, bool]] = []
    open_tags: list[tuple[str, float, bool, Place]] = []  # tag, weight, is an article, what holds inside
    opened: Counter[str] = Counter()  # of the open tags
    above: dict[int, int] = {}
    nothing = inside = links = number = 0

    def end_line() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(t for t, _ in held))).strip()
            linked = SPACE.sub(" ", entities.unescape("".join(t for t, linked in held if linked))).strip()
            held.clear()
            if text:
                at = open_tags[-1][3] if open_tags else Place()
                lines.append(Line(text, max(0, len(text) - len(linked)), nothing > 0, at.marked, at.weight, inside > 0, at.block in HEADING, at.around))

    def close() -> str:
        nonlocal nothing, inside, links
        t, w, i, _ = open_tags.pop()
        opened[t] -= 1
        nothing -= w == 0
        inside -= i
        links -= t == "a"
        return t

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in ASIDE:
            end_line()
        elif tag == "br":
            held.append((" ", False))
        if m[2]:
            if opened[tag]:
                while close() != tag:
                    pass
        elif tag not in VOID and not (m[4] or "").endswith("/"):
            if tag == "p":  # an open paragraph ends where the next begins
                while open_tags and open_tags[-1][0] in ("p", "b", "i", "em", "strong", "u", "span") and opened["p"] and open_tags[-1][1] == 1:
                    if close() == "p":
                        break
            number += 1
            w, i = weight_of(tag, m[4], inside > 0), tag in ("article", "main")
            at_tag = open_tags[-1][3] if open_tags else Place()
            if tag in BLOCK and tag not in ("html", "body"):
                home = at_tag.home if tag in PARTS else number
                above[number] = at_tag.home
                at_tag = Place(tag, at_tag.home, home, at_tag.marked, at_tag.weight)
            if w < 1:
                at_tag = at_tag._replace(marked=at_tag.marked or (number if w else 0), weight=min(w, at_tag.weight))
            open_tags.append((tag, w, i, at_tag))
            opened[tag] += 1
            nothing += w == 0
            inside += i
            links += tag == "a"
    rest = page[at:]
    if rest:
        held.append((rest, links > 0))
    end_line()
    return lines, above


def window_sums(weight: np.ndarray) -> np.ndarray:
    """The largest sum of a window around each line."""
    ends = np.cumsum(np.concatenate((np.zeros(WINDOW), weight, np.zeros(WINDOW - 1))))
    total = ends[WINDOW:] - ends[:-WINDOW] if len(weight) else np.zeros(0)  # of the lines i - WINDOW + 1 .. i
    return np.lib.stride_tricks.sliding_window_view(total, WINDOW).max(axis=1) if len(weight) else total


def level_of(weight: np.ndarray, sums: np.ndarray) -> float:
    """The window sum at which half of the text lies."""
    order = np.argsort(sums, kind="stable")
    reached = np.cumsum(weight[order])
    return float(sums[order[np.searchsorted(reached, reached[-1] / 2)]]) if len(sums) else 0.0


def reach_of(above: dict[int, int]) -> dict[int, int]:
    """The last container inside each; containers are numbered as they open, so those inside one have the numbers from its own to that."""
    last: dict[int, int] = {}
    for x in sorted(above, reverse=True):
        last[above[x]] = max(last.get(above[x], above[x]), last.setdefault(x, x))
    return last


def spans_of(places: set[int], last: dict[int, int]) -> tuple[list[int], list[int]]:
    """First and last numbers of the containers in any of `places`, as ranges apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for p in sorted(places):
        if not ends or p > ends[-1]:
            starts.append(p)
            ends.append(last.get(p, p))
    return starts, ends


def dense(lines: list[Line], above: dict[int, int], last_in: dict[int, int], sums: np.ndarray, least: float) -> list[bool]:
    """Which of the lines of one kind lie in a region between surge and dive, its ends cut at containers."""
    surged = sums >= least
    kept = [False] * len(lines)
    n = len(lines)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], surged.astype(np.int8), [0]))))
    cores: set[int] = set()

    def within(spans: tuple[list[int], list[int]], home: int) -> bool:
        i = bisect_right(spans[0], home) - 1
        return i >= 0 and home <= spans[1][i]

    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while a < b and 2 * lines[a].own < len(lines[a].text):  # a region neither begins nor ends with links
            a += 1
        while b > a and 2 * lines[b - 1].own < len(lines[b - 1].text):
            b -= 1
        cuts = [a, *(i for i in range(a + 1, b) if lines[i].around != lines[i - 1].around), b]
        parts = [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if lo < hi]
        own = [window_sums(np.array([x.own for x in lines[lo:hi]], float)).max() >= least for lo, hi in parts]
        if not any(own):  # only together are they dense
            own = [True] * len(parts)
        homes = {lines[lo].around for (lo, _), o in zip(parts, own, strict=True) if o and lines[lo].around}
        inside = spans_of(homes, last_in)
        first, last = own.index(True), len(own) - 1 - own[::-1].index(True)
        while first and (within(inside, lines[parts[first - 1][0]].around) or all(x.heading for x in lines[slice(*parts[first - 1])])):
            first -= 1
        while last + 1 < len(parts) and within(inside, lines[parts[last + 1][0]].around):
            last += 1
        for i in range(parts[first][0], parts[last][1]) if parts else ():
            kept[i] = True
        cores |= homes
    nearest: dict[int, int] = {}  # of the containers with a core at or around them, that core
    for x in above if cores else ():  # outer ones come first
        nearest[x] = x if x in cores else nearest.get(above[x], 0)
    owner = [nearest.get(x.around, 0) for x in lines]
    ends: dict[int, list[int]] = {}
    for i in range(n):
        if kept[i]:
            ends.setdefault(owner[i], [i, i])[1] = i
    for i in range(n):  # between dense parts of one container all text stays
        if owner[i] in ends and owner[i] and ends[owner[i]][0] < i < ends[owner[i]][1] and 2 * lines[i].own >= len(lines[i].text):
            kept[i] = True
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, above = lines_of(page)
    lines = [x for x in lines if not x.nothing]
    has_article = any(x.article and not x.marked for x in lines)
    kinds: dict[tuple[int, float, bool], list[int]] = {}  # lines of one kind: unmarked in and out of the article, and each marked element
    for i, x in enumerate(lines):
        kinds.setdefault((x.marked, x.weight, has_article and not x.article), []).append(i)
    last_in = reach_of(above)
    share = {kind: kind[1] * (OUTSIDE if kind[2] else 1) for kind in kinds}
    weights = {kind: np.array([lines[i].own for i in at], float) * share[kind] for kind, at in kinds.items()}
    sums = {kind: window_sums(w) for kind, w in weights.items()}
    leading = [k for k in kinds if share[k] == 1] or list(kinds)
    level = level_of(np.concatenate([weights[k] for k in leading]), np.concatenate([sums[k] for k in leading])) if kinds else 0.0
    least, keep = max(1e-9, min(SHARE * level, DENSE)), []
    for kind, at in kinds.items():
        some = [lines[i] for i in at]
        if share[kind] == 1 and has_article:
            good = (sums[kind] > 0).tolist()
        elif share[kind] == 1:
            good = dense(some, above, last_in, sums[kind], least)
        else:
            good = dense(some, above, last_in, sums[kind] / share[kind], max(least, FLOOR) / share[kind])
        keep += [i for i, g in zip(at, good, strict=True) if g]
    return "\n".join(lines[i].text for i in sorted(keep))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
