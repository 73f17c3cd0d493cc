"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text. Each block has a cost of being called boilerplate and a
cost of being called content, from its place, tags, class names, links and wording; these
are capacities from the source and to the sink. Neighbouring blocks and blocks close in the
document tree are joined by edges that make it dear to part them. The blocks on the source's
side of a minimum cut are the main text.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import mapped

# Elements without text of their own.
SKIPPED = frozenset(
    "script style noscript template svg math head title iframe object canvas select option button textarea datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var ruby rt rp wbr br img".split()
)
# Elements that the start of another ends.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("table ul ol dl td th article section div aside nav main body blockquote form header footer".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|header|masthead|footer|sidebar|side|aside|ad|ads|adv|advert|adverts|"
    r"advertisement|advertising|banner|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|social|share|sharing|related|recommended|comment|comments|reply|"
    r"replies|respond|disqus|discussion|breadcrumb|breadcrumbs|toc|widget|login|search|legal|copyright|pager|pagination|"
    r"skip|toolbar|tags|meta)(?:$|[\s_-])"
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|text|main|maincontent)(?:$|[\s_-])")
LEGAL_WORDS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bsubscribe\b|\badvert", re.I)

# Costs. A block in a boilerplate region is never worth keeping.
REGION, INSIDE, OUTSIDE, LINKS, LEGAL = 40.0, 3.0, 3.0, 4.0, 1.5
SMOOTH = 0.6


class Element(NamedTuple):
    """An open element: how many block elements it is in, which one and in which, and where that one stands."""

    tag: str
    boiler: bool
    content: bool
    skipped: bool
    level: int
    block: int
    parent: int
    base: int


class Blocks(HTMLParser):
    """Text blocks of a page with what their costs depend on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open = [Element("", False, False, False, 0, 0, 0, 0)]
        # Where elements of a name stand among the open ones, and the lowest level since the last block.
        self.at: dict[str, list[int]] = defaultdict(list)
        self.low, self.seen, self.has_article = 0, 0, False
        self._reset_text()

    def _reset_text(self) -> None:
        self.parts, self.linked, self.links, self.heading = [], 0, 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            here = self.open[-1]
            self.blocks.append(
                {
                    "text": text,
                    "linked": min(1.0, self.linked / len(text)),
                    "heading": self.heading,
                    "boiler": here.boiler,
                    "content": here.content,
                    "level": here.level,
                    "common": self.low,
                    "parent": here.parent,
                }
            )
            self.low = here.level
        self._reset_text()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        below = self.open[-1]
        boiler, content = below.boiler, below.content
        found = {k: (v or "").lower() for k, v in attrs}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if tag in CONTENT_TAGS or found.get("role") == "main" or "articlebody" in found.get("itemprop", ""):
            self.has_article, content = True, True
        elif tag not in INLINE and CONTENT_NAMES.search(names) and not BOILER_NAMES.search(names):
            content = True
        whole = tag in ("html", "body")
        if tag in BOILER_TAGS or (tag == "header" and not content) or found.get("role") in BOILER_ROLES:
            boiler = True
        elif not whole and (tag not in INLINE or tag == "span") and BOILER_NAMES.search(names):
            boiler = True
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        self.seen += 1
        skipped = below.skipped or tag in SKIPPED or bool(hidden)
        self.at[tag].append(len(self.open))
        if tag in INLINE:
            self.open.append(below._replace(tag=tag, boiler=boiler, content=content, skipped=skipped))
        else:
            place = (below.level + 1, self.seen, below.block, len(self.open))
            self.open.append(Element(tag, boiler, content, skipped, *place))
        self.links += tag == "a"
        self.heading |= tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _cut(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        while len(self.open) > i:
            self.at[self.open.pop().tag].pop()
        self.low = min(self.low, self.open[-1].level)

    def _close_implied(self, tag: str) -> None:
        ends = CLOSED_BY.get(tag, set())
        while self.at["p"] or any(self.at[x] for x in ends):
            i = max(self.at[x][-1] for x in ("p", *ends, *SCOPES) if self.at[x])
            name = self.open[i].tag
            if name != "p" and name not in ends:
                return
            self._cut(i)
            if name in ends:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        # The end of an inline element reaches no further than the innermost block around it.
        if self.at[tag] and (tag not in INLINE or self.at[tag][-1] > self.open[-1].base):
            self._cut(self.at[tag][-1])
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if self.open[-1].skipped:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def costs(block: dict, has_article: bool) -> tuple[float, float]:
    """What it costs to call a block boilerplate, and to call it content."""
    text = block["text"]
    words = text.count(" ") + 1
    drop, keep = 0.3 + 0.06 * min(words, 40), 0.5 + LINKS * block["linked"]
    if text[-1] in ".!?…\"'”»。":
        drop += 0.7
    if block["content"]:
        drop += INSIDE
    elif has_article:
        keep += OUTSIDE
    if block["heading"]:
        drop += 0.5
    elif words < 4 and not block["content"]:
        keep += 0.8
    if words < 40 and LEGAL_WORDS.search(text):
        keep += LEGAL
    if block["boiler"]:
        keep += REGION
    return drop, keep


def edges(blocks: list[dict]) -> dict[tuple[int, int], float]:
    """Smoothness between blocks that follow each other, and between followers under one parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            apart = block["level"] + blocks[i - 1]["level"] - 2 * block["common"]
            out[i - 1, i] = SMOOTH / (1 + apart / 2)
        parent = block["parent"]
        if parent in last and last[parent] != i - 1:
            out[last[parent], i] = SMOOTH / 2
        last[parent] = i
    return out


def source_side(drop: list[float], keep: list[float], joined: dict[tuple[int, int], float]) -> list[bool]:
    """Nodes on the source's side of a minimum cut; capacities drop from the source, keep to the sink."""
    n = len(drop)
    # What flows straight through a node is pushed first; the rest is an excess or a need.
    rest = [d - k for d, k in zip(drop, keep)]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in joined.items():
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    spent = [False] * n
    for source in range(n):
        while rest[source] > 1e-9 and not spent[source]:
            came, queue, sink = {source: source}, deque([source]), -1
            while queue and sink < 0:
                i = queue.popleft()
                for j, w in room[i].items():
                    if w > 1e-9 and j not in came and not spent[j]:
                        came[j] = i
                        if rest[j] < -1e-9:
                            sink = j
                            break
                        queue.append(j)
            if sink < 0:  # nothing that was reached can pass flow on any more
                for i in came:
                    spent[i] = True
                break
            flow, j = min(rest[source], -rest[sink]), sink
            while j != source:
                flow, j = min(flow, room[came[j]][j]), came[j]
            j = sink
            while j != source:
                i = came[j]
                room[i][j] -= flow
                room[j][i] += flow
                j = i
            rest[source] -= flow
            rest[sink] += flow
    side, queue = [r > 1e-9 for r in rest], deque(i for i, r in enumerate(rest) if r > 1e-9)
    while queue:
        i = queue.popleft()
        for j, w in room[i].items():
            if w > 1e-9 and not side[j]:
                side[j] = True
                queue.append(j)
    return side


def main_text(html: str | None) -> str:
    """The main text of a page: its content blocks, one a line; empty if it has none."""
    reader = Blocks()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    blocks = reader.blocks
    pairs = [costs(b, reader.has_article) for b in blocks]
    side = source_side([p[0] for p in pairs], [p[1] for p in pairs], edges(blocks))
    return "\n".join(b["text"] for b, kept in zip(blocks, side) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages give an empty text. Markup that is broken off or never closed is
    read as far as it goes. Rows that repeat are read each for itself, other columns not at all.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [chosen.schema[k].dataType.simpleString() for k in (0, 1)]
    return mapped(chosen, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
