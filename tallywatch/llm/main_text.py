"""Main text of a web page by tree scoring.

The page is read into a tree (forgiving of missing end tags), and parts that are never the
article leave it: by element (menus, forms, scripts, ...), by role, by being hidden, and by
words of class and id. A part named like that stays if it holds an ``article`` or ``main``,
or, on a page without those, over half of the text that is left. Every paragraph then scores a point, one per comma and one
per hundred characters up to three; its container gets them in full, the next ancestor half, those above
a third of the step before. A container's score is discounted by its link density. The best
one is kept (on a page with an ``article`` or ``main``, of those inside), widened to the ``article`` or ``main`` around it, or else joined by its headings
and those siblings that score well enough or are plain paragraphs.

The text of what is kept: character references decoded, white space within a block turned
into one space, blocks trimmed, empty ones left out, the others joined by one line feed.

Defined results: a null or empty page, and one without text, gives the empty text; text
outside of any element is a paragraph of the body; ties go to the first container; repeated
rows are read alike; an empty table gives an empty result. Nesting may be of any depth.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallywatch.llm.common import place, positional, ship_code

_names = lambda text: frozenset(text.split())

VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Their content is no markup.
RAW = _names("script style textarea title xmp iframe noembed noframes plaintext")
INLINE = _names(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr br img"
)
#: Elements that are no text, but do not end the block they stand in.
SILENT = _names(
    "script style template noscript svg math audio video canvas object iframe button select textarea"
    " input map"
)
#: Elements that are never part of the article.
DROPPED = _names(
    "script style textarea title xmp iframe noembed noframes head nav footer aside form button select option"
    " input menu dialog noscript template svg math object canvas audio video map"
)
ROLES = _names("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar")
#: Words of class and id that name something else than the article.
WORDS = _names(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies copyright disqus footer header login masthead menu modal nav navbar"
    " navigation newsletter notice overlay pagination popup promo promoted promotion recommended related"
    " replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser teasers toolbar widget"
)
CONTAINERS = _names("article body main section div td center html header figure details")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
#: A start tag closes an open element of these, if no element of the second set is between.
CLOSES = {
    "li": (_names("li"), _names("ul ol menu")),
    "dt": (_names("dt dd"), _names("dl")),
    "dd": (_names("dt dd"), _names("dl")),
    "tr": (_names("tr td th"), _names("table")),
    "td": (_names("td th"), _names("tr table")),
    "th": (_names("td th"), _names("tr table")),
    "option": (_names("option"), _names("select")),
}
#: An open paragraph ends where one of these starts, unless it is in a nested cell or object.
BLOCK_BARRIER = _names("td th table button object caption html body")
PARAGRAPH, LINK = _names("p"), _names("a")

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
SPLIT_WORDS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Ends:
    """Where tags end: at the first ``>`` outside of quotes, looked up in one pass from the right.

    From each quote the next of its kind is known, so no start is ever scanned twice. A tag
    whose quotes leave no such ``>`` ends at the first one, in quotes or not.
    """

    def __init__(self, source: str) -> None:
        self.at = [m.start() for m in SPECIAL.finditer(source)]
        self.outside = [-1] * (len(self.at) + 1)
        self.any = [-1] * (len(self.at) + 1)
        following = {}
        for k in range(len(self.at) - 1, -1, -1):
            mark = source[self.at[k]]
            if mark == ">":
                self.outside[k] = self.any[k] = self.at[k]
                continue
            closing = following.get(mark)
            self.outside[k] = -1 if closing is None else self.outside[closing + 1]
            self.any[k] = self.any[k + 1]
            following[mark] = k

    def after(self, place: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``place``; there is one."""
        k = bisect_left(self.at, place)
        return self.outside[k] if self.outside[k] >= 0 else self.any[k]


def markup(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Start, end, whether an end tag, name and attributes of each piece of markup.

    Comments and declarations have no name; they reach to the end of the page if nothing
    ends them. A ``<`` that begins no markup is text. The place goes forward only; a caller that
    skips content sends the place to go on from.
    """
    ends = Ends(source)
    at = source.find("<")
    while at >= 0:
        follows = source[at + 1 : at + 2]
        start, stop, closing, name, rest = at, -1, False, None, ""
        if follows in ("!", "?"):
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                stop = -1 if stop < 0 else stop + 3
            elif source.startswith("<![CDATA[", at):
                stop = source.find("]]>", at + 9)
                stop = -1 if stop < 0 else stop + 3
            else:
                stop = source.find(">", at + 2) + 1 or -1
            stop = len(source) if stop < 0 else stop
        elif ends.any[bisect_left(ends.at, at)] >= 0:
            # Some > follows, so a tag that begins here ends too.
            closing = follows == "/"
            found = NAME.match(source, at + 1 + closing)
            if found:
                end = ends.after(found.end())
                name, rest, stop = found.group().lower(), source[found.end() : end], end + 1
            elif closing:
                stop = ends.any[bisect_left(ends.at, at + 2)] + 1
        if stop < 0:
            at = source.find("<", at + 1)
            continue
        skip = yield start, stop, closing, name, rest
        at = source.find("<", stop if skip is None else skip)
        if skip is not None:
            yield  # the answer to the skip


class Page:
    """The tree, in order of the page: node n has its subtree in n..end[n] - 1."""

    def __init__(self, source: str) -> None:
        self.tag = ["html"]
        self.parent = [-1]
        self.end = [0]
        self.attributes = [""]
        #: Text with its node and its flow: text of one flow belongs to one block.
        self.texts: list[tuple[int, int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_nodes = [0]
        #: Depths of the open elements of each name, and of those that are not inline.
        where: dict[str, list[int]] = {}
        solid = [0]
        flow = 0
        at = 0
        lowered = None

        def text(piece: str) -> None:
            if piece:
                self.texts.append((open_nodes[-1], flow, entities.unescape(piece) if "&" in piece else piece))

        def close_to(depth: int) -> bool:
            """Close all nodes above ``depth``; whether one of them was a block."""
            block = False
            while len(open_nodes) > depth:
                node = open_nodes.pop()
                name = self.tag[node]
                self.end[node] = len(self.tag)
                if open_nodes:
                    where[name].pop()
                if name not in INLINE:
                    solid.pop()
                    block |= name not in SILENT
            return block

        def depth_of(tags: frozenset[str]) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        def find(tags: frozenset[str], barrier: frozenset[str]) -> int | None:
            """Depth of the innermost open element of ``tags`` before a barrier."""
            depth = depth_of(tags)
            return depth if depth > depth_of(barrier) else None

        pieces = markup(source)
        for start, stop, closing, name, attributes in pieces:
            text(source[at:start])
            at = stop
            if name is None:
                continue
            if closing:
                if where.get(name):
                    depth = where[name][-1]
                    # The end of an inline element does not end the blocks around its start.
                    if name in INLINE and solid[-1] > depth:
                        continue
                    if close_to(depth):
                        flow += 1
                elif name not in INLINE and name not in SILENT:
                    flow += 1
                continue
            if name == "br":
                self.texts.append((open_nodes[-1], flow, " "))
                continue
            if name in ("html", "body") and where.get(name):
                continue
            block = name not in INLINE and name not in SILENT
            if block:
                flow += 1
                if name in CLOSES:
                    depth = find(*CLOSES[name])
                    while depth is not None:
                        close_to(depth)
                        depth = find(*CLOSES[name])
                else:
                    depth = find(PARAGRAPH, BLOCK_BARRIER)
                    if depth is not None:
                        close_to(depth)
            elif name == "a":
                depth = find(LINK, BLOCK_BARRIER)
                if depth is not None and solid[-1] < depth:
                    close_to(depth)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(open_nodes[-1])
            self.end.append(node + 1)
            self.attributes.append(attributes)
            if name in VOID:
                continue
            if name in RAW:
                if lowered is None:
                    lowered = source.lower()
                    if len(lowered) != len(source):
                        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in source)
                ending = lowered.find("</" + name, at)
                if ending < 0:
                    at = len(source)
                    break
                close = source.find(">", ending)
                at = len(source) if close < 0 else close + 1
                pieces.send(at)
                continue
            if attributes.endswith("/") and name in ("svg", "math", "path"):
                continue
            where.setdefault(name, []).append(len(open_nodes))
            if name not in INLINE:
                solid.append(len(open_nodes))
            open_nodes.append(node)
        text(source[at:])
        close_to(0)

    def named(self, node: int) -> tuple[bool, bool]:
        """Whether the node is certainly no article, and whether its names say so."""
        raw = self.attributes[node]
        if not raw.strip():
            return False, False
        found = {}
        for key, a, b, c, bare in ATTRIBUTE.findall(raw):
            found.setdefault((key or bare).lower(), a or b or c)
        sure = (
            "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or bool(set(found.get("role", "").lower().split()) & ROLES)
            or bool(HIDDEN.search(found.get("style", "")))
        )
        words = found.get("class", "") + " " + found.get("id", "")
        return sure, any(w.lower() in WORDS for w in SPLIT_WORDS.split(words))


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = Page(source)
    tag, parent, end = page.tag, page.parent, page.end
    n = len(tag)
    lengths = [0] * (n + 1)
    for node, _, text in page.texts:
        lengths[node] += len(text.strip())

    def below(values: list[float]) -> list[float]:
        """Running totals: of a subtree, the difference of two."""
        total = [0.0]
        for v in values:
            total.append(total[-1] + v)
        return total

    # What is no article goes: first what is sure, then what only its name tells.
    in_article = [False] * n
    gone = [False] * n
    suspects = []
    for node in range(n):
        up = parent[node]
        if up >= 0:
            in_article[node] = in_article[up]
            gone[node] = gone[up]
        if gone[node]:
            continue
        name = tag[node]
        sure, maybe = page.named(node)
        if name in DROPPED or (name == "header" and not in_article[node]) or (
            sure and name not in ("html", "body")
        ):
            gone[node] = True
        elif maybe and name not in ("html", "body", "main"):
            suspects.append(node)
        if name in ("article", "main"):
            in_article[node] = True
    left = below([0 if gone[i] else lengths[i] for i in range(n)])
    articles = below([tag[i] in ("article", "main") and not gone[i] for i in range(n)])
    whole = left[n]
    for node in suspects:
        if gone[node]:
            continue
        holds = articles[end[node]] - articles[node + 1] > 0 and tag[node] != "article"
        heavy = not articles[n] and 2 * (left[end[node]] - left[node]) > whole
        if not holds and not heavy:
            for i in range(node, end[node]):
                gone[i] = True

    # Blocks with their container, and the points they pass on.
    in_link = [False] * n
    block = list(range(n))
    for node in range(1, n):
        in_link[node] = in_link[parent[node]] or tag[node] == "a"
        if tag[node] in INLINE:
            block[node] = block[parent[node]]
    direct, linked = [0.0] * n, [0.0] * n
    flows: dict[int, tuple[int, list[str]]] = {}
    for node, flow, text in page.texts:
        if gone[node]:
            continue
        size = len(text.strip())
        direct[node] += size
        if in_link[node]:
            linked[node] += size
        flows.setdefault(flow, (block[node], []))[1].append(text)
    points = [0.0] * n
    for node, pieces in flows.values():
        text = " ".join("".join(pieces).split())
        if not text:
            continue
        value = (len(text) >= 25) + text.count(",") + min(len(text) / 100, 3.0)
        if tag[node] not in CONTAINERS and parent[node] >= 0:
            node = block[parent[node]]
        share = 1.0
        for level in range(5):
            points[node] += value * share
            if parent[node] < 0:
                break
            node = block[parent[node]]
            share = 0.5 if level == 0 else share / 3
    chars, links = below(direct), below(linked)

    def density(node: int) -> float:
        size = chars[end[node]] - chars[node]
        return (links[end[node]] - links[node]) / size if size else 0.0

    scores = {i: points[i] * (1 - density(i)) for i in range(n) if points[i] and not gone[i]}
    if not scores:
        return ""
    # Where a page marks its article, nothing else is it.
    best = max(
        [i for i in scores if in_article[i]] or scores, key=lambda i: (scores[i], -i)
    )
    top = best
    while top >= 0 and tag[top] not in ("article", "main"):
        top = parent[top]
    if top >= 0:
        kept = [(top, end[top])]
    elif parent[best] < 0:
        kept = [(best, end[best])]
    else:
        kept = []
        enough = max(10.0, 0.2 * scores[best])
        child = parent[best] + 1
        while child < end[parent[best]]:
            size = chars[end[child]] - chars[child]
            plain = tag[child] == "p" and size and (
                (size > 80 and density(child) < 0.25) or (size <= 80 and density(child) == 0)
            )
            heading = tag[child] in HEADINGS and density(child) < 0.25
            if child == best or scores.get(child, 0) >= enough or plain or heading:
                kept.append((child, end[child]))
            child = end[child]
    out, last = [], None
    place = 0
    for node, flow, text in page.texts:
        if gone[node]:
            continue
        while place < len(kept) and kept[place][1] <= node:
            place += 1
        if place == len(kept):
            break
        if node < kept[place][0]:
            continue
        if flow != last:
            out.append([])
            last = flow
        out[-1].append(text)
    blocks = (" ".join("".join(pieces).split()) for pieces in out)
    return "\n".join(b for b in blocks if b)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``."""
    ship_code(pages.sparkSession)
    columns = pages.columns
    at = place(columns, "html")
    rows = positional(pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h.as_py()) for h in batch.column(at)], pa.string())
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, texts], names=[*names, "text"])

    kept = [(n, t) for i, (n, t) in enumerate(rows.dtypes) if i != at]
    done = rows.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in [*kept, ("text", "string")]))
    return done.toDF(*[n for i, n in enumerate(columns) if i != at], "text")
