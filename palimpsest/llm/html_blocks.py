"""Main text of web pages by line-block distribution (Chen 2010).

Markup is stripped into lines, one for each block element. A line in a menu, header, footer, sidebar, notice,
advert, form or comment weighs nothing, nor does one that is mostly a link; any other weighs its characters. The
weights of WINDOW lines from each line on are summed: where the sum rises above the surge threshold, main text
starts, and where it dives to nothing, it ends.

* A page that marks articles (or else ``main``): windows are summed inside each mark. The marks with a surge are main
  text; those without (teasers, empty frames) are not.
* Any other page: everything between the first surge and the last dive is main text, and so are the lines around the
  heaviest run in the block that holds the run, so that short first and last paragraphs are not lost.

Lines that weigh nothing because they are boilerplate never come back; single lines of links between kept lines do.
"""

from __future__ import annotations

import heapq
import html as H
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .streams import slices

#: Lines summed at once, the sum that makes a surge (less on pages whose largest sum is under twice that), link-only
#: lines in a row that are a menu, and the share of link text from which a line is one of links.
WINDOW, SURGE, MENU, LINKED = 3, 86, 3, 0.6

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select|button|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!(?:\[CDATA\[.*?\]\]|[^>]*)>|<\?[^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_SHOW = re.compile(r"display\s*:\s*none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_NO_TEXT = frozenset("nav footer aside head menu dialog fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("li dt dd tr td th option".split())
#: Elements that no name of theirs makes boilerplate.
_NEVER = frozenset("html body main article".split())
#: A class, id or role is boilerplate where one of its parts (between - or _) is one of these and all others are neutral.
_COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
_BOILER = _COMMENTS | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsense alert aside banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommendations recommended related "
    "search share sharing sidebar signup sitenav skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_NEUTRAL = frozenset(
    "area article bar block body bottom box button buttons buttonlist center column container content div footer form global group head header holder inner items left link links list main "
    "message outer page panel pane popular post posts primary right role row secondary section site small stories sub tertiary thread top unit wrap wrapper".split()
)
_EXACT = frozenset("site-header page-header global-header".split())


@dataclass(frozen=True)
class Line:
    text: str
    block: int  # the innermost block that holds it
    boiler: bool
    mark: int  # the outermost article (or main) that holds it, -1 for none
    links: int  # characters of it in links


@dataclass
class Page:
    lines: list[Line]
    parents: list[int]  # of each block; block 0 is the document
    tags: list[str]
    articles: set[int]
    mains: set[int]


def _attributes(raw: str) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip("/ \t\r\n") else {}


def _family(attributes: dict[str, str]) -> str:
    """'comment' or 'other' where a class, id or role names boilerplate, else ''."""
    found = ""
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").lower().split():
            parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
            hits = [p for p in parts if p in _BOILER]
            if token in _EXACT or hits and all(p in _BOILER or p in _NEUTRAL for p in parts):
                if any(p in _COMMENTS for p in hits):
                    return "comment"
                found = "other"
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NO_SHOW.search(attributes.get("style", "")))


class _Parser:
    def __init__(self):
        self.out: list[tuple[str, int, int]] = []  # text, block, characters in links
        self.parents, self.tags = [-1], [""]
        self.kind = [""]  # why a block is boilerplate: 'always', 'comment', 'other', 'form' or '' for it is not
        self.mark = [-1]  # the outermost article or main at a block
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag
        self.named: list[int] = []  # open blocks that are boilerplate by a name, or forms
        self.held: list[str] = []
        self.links, self.in_link = 0, False
        self.articles: set[int] = set()
        self.mains: set[int] = set()

    def flush(self) -> None:
        if self.held:
            text = " ".join(H.unescape("".join(self.held)).split())
            if text:
                self.out.append((text, self.stack[-1], self.links))
            self.held.clear()
        self.links = 0

    def push(self, tag: str, kind: str) -> None:
        block = len(self.parents)
        self.parents.append(self.stack[-1])
        self.tags.append(tag)
        self.kind.append(kind)
        mark = self.mark[self.stack[-1]]
        if not kind and tag == "article" and mark not in self.articles:
            mark = block
            self.articles.add(block)
        elif not kind and tag == "main" and mark < 0:
            mark = block
            self.mains.add(block)
        self.mark.append(mark)
        self.open[tag].append(len(self.stack))
        self.stack.append(block)
        if kind in ("other", "form"):
            self.named.append(block)

    def pop_to(self, i: int) -> None:
        for block in reversed(self.stack[i:]):
            self.open[self.tags[block]].pop()
            if self.named and self.named[-1] >= block:  # blocks are numbered as they open
                self.named.pop()
        del self.stack[i:]

    def start(self, tag: str, raw: str) -> None:
        attributes = _attributes(raw)
        family = _family(attributes) if attributes else ""
        hidden = bool(attributes) and _hidden(attributes)
        if tag == "span":  # an inline box matters only where it is boilerplate or hidden
            kind = "always" if hidden else family
            if kind:
                self.flush()
            self.push(tag, kind)
            return
        top = self.tags[self.stack[-1]]
        if top == "p" or top in _HEADINGS or tag in _CELLS and top == tag:
            self.pop_to(len(self.stack) - 1)
        if hidden or tag in _NO_TEXT or tag == "header" and self.mark[self.stack[-1]] < 0:
            kind = "always"
        elif tag in _NEVER:
            kind = "comment" if tag == "article" and family == "comment" else ""
        else:
            kind = family or ("form" if tag == "form" else "")
        if tag in ("main", "article") and not kind:  # whatever holds a mark is no boilerplate by its name
            for block in self.named:
                self.kind[block] = ""
            self.named.clear()
        self.push(tag, kind)

    def feed(self, page: str) -> _Parser:
        page = _RAW.sub("\n", page.replace("\x00", "") + "<z>")  # a tag at the end, so that every tag has one
        at = 0
        for m in _TAG.finditer(page):
            if m.start() > at:
                self.held.append(page[at : m.start()])
                if self.in_link:
                    self.links += m.start() - at
            at = m.end()
            close, tag, raw = (m.group(1), m.group(2).lower(), m.group(3)) if m.group(2) else (m.group(4), m.group(5).lower(), m.group(6))
            if tag == "a":
                self.in_link = not close
            if tag not in _BLOCK and tag != "span" or tag in _VOID:
                if tag in ("br", "hr"):
                    self.flush()
                continue
            if tag != "span" or close and self.open["span"] and self.kind[self.stack[self.open["span"][-1]]]:
                self.flush()
            if close:
                if self.open[tag]:
                    self.pop_to(self.open[tag][-1])
            elif not raw.endswith("/"):
                self.start(tag, raw)
        self.held.append(page[at:])
        self.flush()
        return self

    def page(self, named: bool = True) -> Page:
        """The lines; without ``named``, names make nothing boilerplate but comments."""
        drop = [False] * len(self.parents)
        size = [0] * len(self.parents)
        for text, block, _ in self.out:
            size[block] += len(text)
        for block in range(len(self.parents) - 1, 0, -1):
            size[self.parents[block]] += size[block]
        for block in range(1, len(self.parents)):  # parents come before their children
            kind = self.kind[block]
            kind = "" if kind == "other" and not named else kind
            whole = kind == "form" and 2 * size[block] > size[0]  # a form round the page drops only its controls
            drop[block] = drop[self.parents[block]] or bool(kind) and not whole
        lines = [Line(text, block, drop[block], self.mark[block], min(links, len(text))) for text, block, links in self.out]
        alive = lambda marks: {b for b in marks if not drop[b]}
        return Page(lines, self.parents, self.tags, alive(self.articles), alive(self.mains))


def _linked(x: Line) -> bool:
    return x.links > LINKED * len(x.text)


def _weights(lines: list[Line]) -> list[int]:
    return [0 if x.boiler or _linked(x) else len(x.text) for x in lines]


def _sums(weights: list[int]) -> list[int]:
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def _menus(lines: list[Line]) -> set[int]:
    """Lines in runs of MENU or more that are links and nothing else: their windows hold no text."""
    out: set[int] = set()
    run: list[int] = []
    for i, x in enumerate([*lines, None]):
        if x is not None and not x.boiler and _linked(x):
            run.append(i)
            continue
        if len(run) >= MENU:
            out.update(run)
        run = []
    return out


def _runs(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches from each surge to its dive."""
    sums, out, i = _sums(weights), [], 0
    while i < len(weights):
        if weights[i] and sums[i] > surge:
            j = i
            while j < len(weights) and (sums[j] or weights[j]):
                j += 1
            out.append((i, max(k for k in range(i, j) if weights[k])))
            i = j
        else:
            i += 1
    return out


def _held(page: Page, holder: int) -> list[bool]:
    """For each block whether ``holder`` holds it; parents come before their children."""
    out = [False] * len(page.parents)
    for block in range(holder, len(out)):
        out[block] = block == holder or page.parents[block] >= holder and out[page.parents[block]]
    return out


def _common_block(page: Page, blocks: set[int]) -> int:
    """The innermost block that holds all of ``blocks``; a block's number is greater than its parent's."""
    heap = [-b for b in blocks]
    heapq.heapify(heap)
    seen = set(blocks)
    while len(heap) > 1:
        up = page.parents[-heapq.heappop(heap)]
        if up not in seen:
            seen.add(up)
            heapq.heappush(heap, -up)
    return -heap[0]


def choose(page: Page) -> list[int]:
    """The lines of the main text, by the distribution of line blocks."""
    lines = page.lines
    menu = _menus(lines)
    usable = [i for i, x in enumerate(lines) if not x.boiler and i not in menu]
    for marks in (page.articles, page.mains):
        by_mark: dict[int, list[int]] = {b: [] for b in sorted(marks)}
        for i in usable:
            if lines[i].mark in by_mark:
                by_mark[lines[i].mark].append(i)
        held: dict[int, list[Line]] = defaultdict(list)
        for x in lines:
            held[x.mark].append(x)
        sums = {b: max(_sums(_weights(held[b])), default=0) for b, some in by_mark.items() if some}
        if sums:
            surge = min(SURGE, max(sums.values()) // 2)
            chosen = [b for b, s in sums.items() if s > surge] or list(sums)
            return sorted(i for b in chosen for i in by_mark[b])
    weights = [0 if i in menu else w for i, w in enumerate(_weights(lines))]
    runs = _runs(weights, min(SURGE, max(_sums(weights), default=0) // 2))
    if not runs:
        return []
    first, last = runs[0][0], runs[-1][1]
    heavy = max(runs, key=lambda r: (sum(weights[r[0] : r[1] + 1]), -r[0]))
    holder = _common_block(page, {lines[i].block for i in range(heavy[0], heavy[1] + 1) if weights[i]})
    around = _held(page, holder) if page.tags[holder] not in ("", "html", "body") else None
    return [i for i in usable if first <= i <= last or around and around[lines[i].block]]


def main_text(page: str | None) -> str:
    parser = _Parser().feed(page or "")
    found = parser.page()
    chosen = choose(found)
    if not chosen:  # a name on a block round the whole page
        found = parser.page(named=False)
        chosen = choose(found)
    return "\n".join(found.lines[i].text for i in chosen)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (replacing columns so named).

    A null or empty page, and one without main text, has the empty text. Rows are neither joined nor dropped, so
    repeated rows stay and an empty table stays empty. Nothing is shuffled, and no page is cut, however long.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    own = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            texts = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return own.mapInArrow(run, StructType([f for f in own.schema.fields if f.name != "__html"]).add("text", StringType()).add("n_chars", LongType()))
