"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier says how likely each is
content; the costs of either label are the capacities to source and sink.
Neighbouring blocks, the more the nearer they stand in the document tree, are
tied together. The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by what they do to text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q s "
    "samp small span strike strong sub sup time tt u var wbr ruby rt rp picture source track area "
    "map embed param col base link meta math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle "
    "mpadded menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none "
    "mtable mtr mtd semantics".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen frame".split()
)
SKIPPED = frozenset(
    "script style noscript template svg canvas object iframe select textarea head "
    "title audio video datalist applet noframes".split()
)
RAW = frozenset("script style textarea title iframe noframes noscript".split())
#: Second forms of a formula, left out within its block.
NOTES = frozenset({"annotation", "annotation-xml"})
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

#: Elements and roles whose text is hardly ever content, and those that hold it.
APART = frozenset("nav footer aside form menu dialog fieldset search button".split())
APART_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu "
    "menubar toolbar tablist".split()
)
MAIN = frozenset({"article", "main"})
_AGAINST = re.compile(
    r"(?:^|[\s_-])(ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|"
    r"notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|"
    r"paywall|share\w*|sharing|social\w*|sidebar\w*|side|aside|rail|related\w*|recommend\w*|"
    r"comment\w*|disqus|respond|repl(?:y|ies)|discussion|menu\w*|nav\w*|breadcrumb\w*|"
    r"foot(?:er)?|footer\w*|masthead|topbar|toolbar|widget\w*|login|signin|signup|register|"
    r"search\w*|pag(?:er|ination)|tags?|copyright|disclaimer|skip|hidden|print-only)(?=$|[\s_-])"
)
_FOR = re.compile(
    r"(?:^|[\s_-])(?:article\w*|post|content|entry|story|main|body|text|prose)(?:$|[\s_-])"
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][-\w:]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][-\w:]*)([^>]*)(?:>|\Z)""",
    re.S,
)

#: The classifier's weights.
WEIGHTS = {
    "bias": -1.6,
    "main": 4.0,
    "apart": -7.0,
    "against": -6.5,
    "for": 1.0,
    "links": -4.0,
    "words": 0.75,
    "sentence": 0.8,
    "heading": 0.5,
    "bare": 3.0,
}
#: Tie of neighbours in the page, shared by how far apart they are in the tree, and of siblings.
NEXT, SIBLING = 1.6, 0.6


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    main: bool = False
    apart: bool = False
    hints: frozenset[str] = frozenset()  # words against content in its own class and id
    hinted: Element | None = None  # the nearest with such words, itself or above
    helps: bool = False
    skipped: bool = False


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    against: bool = False


def _element(name: str, attributes: str, parent: Element | None) -> Element:
    made = Element(name, parent, parent.depth + 1 if parent else 0)
    if parent:
        made.main, made.apart, made.hinted = parent.main, parent.apart, parent.hinted
        made.helps, made.skipped = parent.helps, parent.skipped
    made.skipped = made.skipped or name in SKIPPED
    made.apart = made.apart or name in APART or (name == "header" and not made.main)
    made.main = made.main or name in MAIN
    if attributes.strip():
        found = {
            k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)
        }
        role = found.get("role", "")
        made.apart = made.apart or role in APART_ROLES
        made.main = made.main or role == "main" or found.get("itemprop") == "articlebody"
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        if names and name not in ("html", "body"):
            made.hints = frozenset(_AGAINST.findall(names))
            made.hinted = made if made.hints else made.hinted
            made.helps = made.helps or bool(_FOR.search(names))
        style = found.get("style", "").replace(" ", "")
        made.apart = made.apart or "hidden" in found or "display:none" in style
    return made


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, character references decoded, white space made single."""
    found: list[Block] = []
    top = Element("", None, 0)
    stack = [top]
    block = Block(top)
    links = 0

    def end() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text = text
            found.append(block)
        block = Block(stack[-1])

    def add(text: str) -> None:
        if text and not stack[-1].skipped:
            text = html.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if not token:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        if name in NOTES:
            if not (token[1] or token[4]):
                close = re.compile(rf"</{name}\s*>|</(?:semantics|math)\b", re.I).search(page, at)
                at = close.start() if close else at
            continue
        if token[1] or token[4]:  # an end
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                block.parts.append(" ")
            if name in INLINE:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    end()
                    del stack[i:]
                    block = Block(stack[-1])
                    break
            else:
                end()
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            elif name in ("br", "img", "input", "wbr"):
                block.parts.append(" " if name != "wbr" else "")
            continue
        end()
        links = 0
        if stack[-1].name == "p" or name in CLOSES:
            closed = CLOSES.get(name, frozenset()) | {"p"}
            while stack[-1].name in closed:
                stack.pop()
        if name in VOID:
            block = Block(stack[-1])
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            block = Block(stack[-1])
            continue
        stack.append(_element(name, token[3] or token[6] or "", stack[-1]))
        block = Block(stack[-1])
    end()
    _weigh_hints(found)
    return found


def _above(element: Element) -> Iterator[Element]:
    """Elements with hints, from the nearest on."""
    at = element.hinted
    while at is not None:
        yield at
        at = at.parent.hinted if at.parent else None


def _weigh_hints(found: list[Block]) -> None:
    """Mark blocks that the class or id of an element above speaks against.

    An element, or all with one word, that holds over half of the text that
    is not apart is a wrapper and speaks against nothing; unless the page has
    a paragraph in its article or main that no hint is about.
    """
    texts = [b for b in found if not b.element.apart]
    half = sum(len(b.text) for b in texts) / 2
    if any(b.element.main and not b.element.hinted and b.text.count(" ") >= 20 for b in texts):
        half = math.inf
    held: Counter[int] = Counter()
    for b in texts:
        for e in _above(b.element):
            held[id(e)] += len(b.text)
    spread: Counter[str] = Counter()
    for b in texts:
        near = [e.hints for e in _above(b.element) if held[id(e)] <= half]
        for word in frozenset().union(*near):
            spread[word] += len(b.text)
    for b in found:
        near = [e.hints for e in _above(b.element) if held[id(e)] <= half]
        b.against = any(spread[word] <= half for word in frozenset().union(*near))


def content_odds(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    where, words = block.element, block.text.split()
    odds = WEIGHTS["bias"] + WEIGHTS["words"] * math.log1p(len(words))
    odds += WEIGHTS["links"] * min(1.0, block.linked / len(block.text))
    odds += WEIGHTS["main"] * where.main + WEIGHTS["apart"] * where.apart
    odds += WEIGHTS["against"] * block.against + WEIGHTS["for"] * where.helps
    odds += WEIGHTS["sentence"] * (block.text[-1] in ".!?:;\"'”»…")
    odds += WEIGHTS["heading"] * (where.name in HEADINGS)
    odds += WEIGHTS["bare"] * (where.name == "")
    return odds


def _distance(one: Element, other: Element) -> int:
    steps = 0
    while one is not other:
        if one.depth >= other.depth and one.parent is not None:
            one = one.parent
        elif other.parent is not None:
            other = other.parent
        else:
            break
        steps += 1
    return steps


def ties(found: list[Block]) -> dict[tuple[int, int], float]:
    """Capacities between blocks: next in the page by nearness in the tree, and next sibling."""
    result: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            result[i - 1, i] = NEXT / (1 + _distance(found[i - 1].element, block.element))
        parent = id(block.element.parent)
        before = last.get(parent)
        if before is not None:
            result[before, i] = result.get((before, i), 0.0) + SIBLING
        last[parent] = i
    return result


def minimum_cut(gains: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    ``gains`` are capacities from the source minus those to the sink. A node
    whose gain outweighs all its ties keeps its side in some minimum cut; it
    is fixed and its ties pass into its neighbours' gains. What is left goes
    through augmenting paths.
    """
    gains = list(gains)
    links: list[dict[int, float]] = [{} for _ in gains]
    for (a, b), w in edges.items():
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * len(gains)
    queue = deque(range(len(gains)))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(gains[i]) < sum(links[i].values()):
            continue
        side[i] = gains[i] > 0
        for j, w in links[i].items():
            gains[j] += w if side[i] else -w
            del links[j][i]
            queue.append(j)
        links[i] = {}
    left = [i for i in range(len(gains)) if side[i] is None]
    for i in _reached(left, gains, links):
        side[i] = True
    return [bool(s) for s in side]


def _reached(nodes: list[int], gains: list[float], room: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches when no path to the sink is left."""
    excess = {i: max(0.0, gains[i]) for i in nodes}
    drain = {i: max(0.0, -gains[i]) for i in nodes}
    while True:
        came: dict[int, int | None] = {i: None for i in nodes if excess[i] > 1e-12}
        queue, goal = deque(came), None
        while queue and goal is None:
            i = queue.popleft()
            if drain[i] > 1e-12:
                goal = i
                break
            for j, w in room[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal is None:
            return set(came)
        path = [goal]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        flow = min(excess[path[-1]], drain[goal])
        for b, a in zip(path, path[1:], strict=False):
            flow = min(flow, room[a][b])
        excess[path[-1]] -= flow
        drain[goal] -= flow
        for b, a in zip(path, path[1:], strict=False):
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


def main_text(page: str) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    kept = minimum_cut([content_odds(b) for b in found], ties(found))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    The whole html is read. Blocks are trimmed, white space in them is single,
    and they are joined by a line feed in page order. A null or empty html, or
    one without content, gives an empty text. Unclosed and stray tags are
    borne. Repeated rows are extracted each; null ids and urls stay null; other
    columns are not read.
    """

    @F.pandas_udf("string")
    def extract(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s) if isinstance(s, str) else "" for s in sources], dtype=object)

    found = pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
