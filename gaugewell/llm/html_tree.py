"""Small helpers on HTML: a forgiving tree builder and simple tree matching."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np

#: Names fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript iframe svg template textarea select object canvas math".split())
#: A start tag closes these open elements, up to the limits.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot", "table")}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


WORD = re.compile(r"[a-z0-9]+")
NOTHING: frozenset[str] = frozenset()
#: Words of names that tell what an element has, lacks or does, and not what it is.
STATES = frozenset("no not non has have with without is hide hidden show shows open closed enabled disabled supports".split())


class Node:
    """An element: its tag, the words of its class and id, those that say what it is, its role or item property, and what it holds.

    ``says`` has the names that are one word, ``hints`` the words of longer names, but for those that only tell what the
    element has or lacks (``no-sidebar``, ``has-comments``).
    """

    __slots__ = ("tag", "names", "says", "hints", "role", "parts")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.role, self.parts = tag, "", []
        names: list[str] = []
        self.says, self.hints = NOTHING, NOTHING
        if attributes and "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = html.unescape("".join(values)).lower()
                if key.lower() in ("class", "id"):
                    for name in value.split():
                        words = WORD.findall(name)
                        names += words
                        if len(words) == 1:
                            self.says = self.says | {words[0]}
                        elif words and STATES.isdisjoint(words):
                            self.hints = self.hints.union(words)
                else:
                    self.role = value.strip()
        self.names = names

    @property
    def label(self) -> str:
        """What two nodes must have in common to be matched."""
        return f"{self.tag}.{'-'.join(self.names)}" if self.names else self.tag

    def children(self) -> list[Node]:
        """The elements among its parts."""
        return [x for x in self.parts if not isinstance(x, str)]


def parse(source: str) -> Node:
    """The tree of a page. End tags that are missing, crossed or left over are put right; nothing is rejected."""
    root = Node("#page")
    stack, at, lower = [root], 0, None
    # Depths of the open elements of each tag, and of all open blocks: what is closed is found without a walk.
    where: dict[str, list[int]] = {}
    blocks: list[int] = []

    def close_from(depth: int) -> None:
        for x in reversed(stack[depth:]):
            where[x.tag].pop()
            if x.tag in BLOCK:
                blocks.pop()
        del stack[depth:]

    # Past the last ">" no tag ends, and a search for its end would run through the rest at every "<".
    last = source.rfind(">") + 1
    for found in TOKEN.finditer(source, 0, last):
        if found.start() < at:
            continue
        if found.start() > at:
            stack[-1].parts.append(source[at : found.start()])
        at = found.end()
        tag = found.group(2) or found.group(5)
        if tag is None:
            if at == last and source.startswith("<!--", found.start()) and not source.endswith("-->", found.start(), at):
                at = len(source)
            continue
        tag = tag.lower()
        if found.group(1) or found.group(4):
            open_ = where.get(tag)
            # The end of an inline element does not close a block around which it was opened.
            if open_ and (tag in BLOCK or not blocks or blocks[-1] < open_[-1]):
                close_from(open_[-1])
            continue
        if tag in BLOCK:
            close, limits = CLOSES.get(tag, (frozenset(("p",)), frozenset(("article", "div", "section", "td", "th", "li", "body", "table", "button"))))
            nearest = max((where[t][-1] for t in close if where.get(t)), default=0)
            if nearest and nearest > max((where[t][-1] for t in limits if where.get(t)), default=0):
                close_from(nearest)
        node = Node(tag, found.group(3) or found.group(6) or "")
        stack[-1].parts.append(node)
        if tag in VOID or (found.group(3) or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = source.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            close = lower.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(source)
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    if at < len(source):
        # A declaration that does not end takes the rest.
        rest = re.search(r"<[!?]", source[at:])
        text = source[at : at + rest.start()] if rest else source[at:]
        if text:
            stack[-1].parts.append(text)
    return root


def clean(text: str) -> str:
    """Character references decoded, runs of white space as one space, trimmed."""
    return " ".join(html.unescape(text).split())


def structures(roots: Iterable[Node]) -> dict[int, int]:
    """The number of each node's structure, by its ``id``: equal for nodes whose subtrees have equal labels throughout."""
    known: dict[tuple, int] = {}
    number: dict[int, int] = {}
    for root in roots:
        todo = [(root, False)]
        while todo:
            node, ready = todo.pop()
            inner = node.children()
            if ready or not inner:
                key = (node.label, *[number[id(x)] for x in inner])
                number[id(node)] = known.setdefault(key, len(known))
            else:
                todo.append((node, True))
                todo += [(x, False) for x in inner]
    return number


class Matcher:
    """Simple tree matching: children are aligned in order, so that the matched subtrees hold as many nodes as possible.

    Subtrees of one structure are weighed once, whatever their number, and equal structures match whole. Lists of
    children are aligned by dynamic programming over numpy rows; long ones are halved until the table is small, which
    gives the same best weight in memory that grows with the list. Nothing recurses.
    """

    #: Cells of a table that is kept whole; longer lists are halved first.
    WHOLE = 1 << 20

    def __init__(self, roots: list[Node]) -> None:
        self.number = structures(roots)
        self.label: dict[int, str] = {}
        self.inner: dict[int, list[int]] = {}
        self.size: dict[int, int] = {}
        self.weights: dict[tuple[int, int], int] = {}
        for root in roots:
            todo, order = [root], []
            while todo:
                node = todo.pop()
                own = self.number[id(node)]
                if own not in self.label:
                    self.label[own] = node.label
                    self.inner[own] = [self.number[id(x)] for x in node.children()]
                    order.append(own)
                    todo += node.children()
            # Structures are numbered after those they hold.
            for own in sorted(order):
                self.size[own] = 1 + sum(self.size[x] for x in self.inner[own])

    def _simple(self, a: int, b: int) -> int | None:
        """The weight of two structures where it needs no table."""
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        if not self.inner[a] or not self.inner[b]:
            return 1
        return self.weights.get((a, b))

    def weight(self, a: int, b: int) -> int:
        """How many nodes of two structures can be matched."""
        todo = [(a, b)]
        while todo:
            one, other = todo[-1]
            if self._simple(one, other) is not None:
                todo.pop()
                continue
            lacking = [(x, y) for x in set(self.inner[one]) for y in set(self.inner[other]) if self._simple(x, y) is None]
            if lacking:
                todo += lacking
                continue
            self.weights[one, other] = 1 + int(self._last_row(self.inner[one], self.inner[other])[-1])
            todo.pop()
        return self._simple(a, b)

    def _rows(self, left: list[int], right: list[int]) -> Iterator[np.ndarray]:
        """The rows of the table of best weights."""
        row = np.zeros(len(right) + 1, np.int64)
        yield row
        kinds, which = np.unique(np.array(right, np.int64), return_inverse=True)
        gains: dict[int, np.ndarray] = {}
        for a in left:
            if a not in gains:
                gains[a] = np.array([self.weight(a, int(b)) for b in kinds], np.int64)[which]
            above, row = row, np.zeros_like(row)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gains[a]), out=row[1:])
            yield row

    def _last_row(self, left: list[int], right: list[int]) -> np.ndarray:
        for row in self._rows(left, right):  # noqa: B007
            pass
        return row

    def aligned(self, left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """Places of the children that a best alignment matches."""
        pairs, todo = [], [(0, len(left), 0, len(right))]
        while todo:
            i, last, j, end = todo.pop()
            # Equal structures at either end are matched by some best alignment.
            while i < last and j < end and left[i] == right[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            while i < last and j < end and left[last - 1] == right[end - 1]:
                last, end = last - 1, end - 1
                pairs.append((last, end))
            if i == last or j == end:
                continue
            if (last - i + 1) * (end - j + 1) > self.WHOLE and last - i > 1:
                half = (i + last) // 2
                ahead = self._last_row(left[i:half], right[j:end])
                behind = self._last_row(left[half:last][::-1], right[j:end][::-1])[::-1]
                at = j + int(np.argmax(ahead + behind))
                todo += [(i, half, j, at), (half, last, at, end)]
                continue
            rows = list(self._rows(left[i:last], right[j:end]))
            x, y = last - i, end - j
            while x and y:
                if rows[x][y] == rows[x - 1][y]:
                    x -= 1
                elif rows[x][y] == rows[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    pairs.append((i + x, j + y))
        return pairs

    def matched(self, one: Node, other: Node) -> list[tuple[Node, Node]]:
        """Pairs of nodes aligned from two roots with one label."""
        pairs, todo = [], [(one, other)]
        while todo:
            a, b = todo.pop()
            pairs.append((a, b))
            left, right = a.children(), b.children()
            if left and right:
                places = self.aligned([self.number[id(x)] for x in left], [self.number[id(x)] for x in right])
                todo += [(left[i], right[j]) for i, j in places]
        return pairs


def matched(one: Node, other: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes aligned by simple tree matching, from two roots with one label."""
    return Matcher([one, other]).matched(one, other)
