"""A small HTML tree builder, and simple tree matching.

Trees are built from one regular-expression pass over the page; end tags that HTML lets authors leave out are supplied, and stray
ones are ignored.  Trees may be of any depth and width.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np

# Fixed values of the HTML standard: void elements, raw-text elements, block-level elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html title option optgroup legend summary td th tr tbody thead tfoot".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_SCOPE = frozenset("button table td th caption object marquee applet html body".split()) | (BLOCK - {"p"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Node:
    """An element, or with tag ``#`` a piece of text."""

    __slots__ = ("tag", "attributes", "children", "text", "symbol")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attributes, self.text = tag, attributes or {}, text
        self.children: list[Node] = []
        a = self.attributes
        name = ((a.get("class") or "").split()[:1] or (a.get("id") or "").split()[:1]) if a else []
        # What tree matching compares: the tag with the first class or the id, whatever numbers stand in it.
        self.symbol = f"{tag}.{re.sub('[0-9]+', '0', name[0])}" if name else tag


def parse(page: str) -> Node:
    """The page's tree under a root node; comments and the contents of raw-text elements are left out."""
    root = Node("root")
    stack = [root]
    starts: dict[str, int] = {}  # how many start tags of a kind were opened: an end tag beyond them needs no search
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not text.isspace():
            stack[-1].children.append(Node("#", text=html.unescape(text)))
        elif text and stack[-1].children and stack[-1].children[-1].tag not in BLOCK:
            stack[-1].children.append(Node("#", text=" "))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not starts.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    starts[tag] -= 1
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, P_SCOPE)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        node = Node(tag, {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else None)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID:
            stack.append(node)
            starts[tag] = starts.get(tag, 0) + 1
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str] | frozenset[str]) -> None:
    """End the nearest open element among ``tags``, unless one of ``scope`` is met before it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def text_of(node: Node) -> str:
    return " ".join(node.text.split())


def digest(text: str) -> int:
    """63 bits of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


@contextmanager
def deep_recursion() -> Iterator[None]:
    """Trees may be as deep as pages are long: plain Python calls take no C stack, so only the counter is in the way."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 10_000_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def runs(node: Node) -> list[list[Node]]:
    """The children that count, as runs of neighbours of one symbol."""
    out: list[list[Node]] = []
    for child in node.children:
        if child.tag == "#" and not child.text.strip():
            continue
        if out and out[-1][0].symbol == child.symbol:
            out[-1].append(child)
        else:
            out.append([child])
    return out


class Matching:
    """Simple tree matching of two trees: the most node pairs that agree in symbol, order and ancestors.

    Neighbours of one symbol, such as paragraphs, are one run in this; the nodes of two runs pair in order, and so do two lists
    of runs with the same symbols.  Other lists are aligned by the weight of what pairs below, whatever their length.

    What can pair below two nodes depends on their shapes alone: the symbols of their subtrees.  Shapes and runs of shapes are
    numbered, so that each pair of them is weighed once for all pages that a matching is used for, and again only where
    ``REMEMBERED`` pairs were forgotten.
    """

    REMEMBERED = 300_000
    HELD = 100_000_000

    def __init__(self):
        self.run_lists: dict[int, list[list[Node]]] = {}
        self.shapes: dict[int, int] = {}  # by node
        self.numbers: dict[tuple, int] = {}
        self.made_of: list[tuple] = []  # of a shape: its symbol, size and runs; of a run: its symbol and shapes
        self.parts = 0
        self.scores: dict[tuple[int, int], int] = {}

    def _runs(self, node: Node) -> list[list[Node]]:
        if id(node) not in self.run_lists:
            self.run_lists[id(node)] = runs(node)
        return self.run_lists[id(node)]

    def _number(self, made_of: tuple) -> int:
        if made_of not in self.numbers:
            self.numbers[made_of] = len(self.made_of)
            self.made_of.append(made_of)
            self.parts += len(made_of[-1])
        return self.numbers[made_of]

    def _shape(self, node: Node) -> int:
        if id(node) not in self.shapes:
            parts = [self._run(run) for run in self._runs(node)]
            size = 1
            for part in parts:
                for shape in self.made_of[part][1]:
                    size += self.made_of[shape][1]
            self.shapes[id(node)] = self._number((node.symbol, size, tuple(parts)))
        return self.shapes[id(node)]

    def _run(self, run: list[Node]) -> int:
        return self._number((run[0].symbol, tuple([self._shape(node) for node in run])))

    def _next_page(self) -> None:
        """Forget nodes, which may be gone, and shapes where they have become many."""
        self.run_lists.clear()
        self.shapes.clear()
        if len(self.made_of) > self.REMEMBERED or self.parts > 10 * self.REMEMBERED:
            self.numbers.clear()
            self.made_of.clear()
            self.scores.clear()
            self.parts = 0

    def score(self, a: Node, b: Node) -> int:
        self._next_page()
        return self._score(self._shape(a), self._shape(b))

    def _score(self, a: int, b: int) -> int:
        (symbol, size, xs), (other, _, ys) = self.made_of[a], self.made_of[b]
        if symbol != other:
            return 0
        if a == b:
            return size
        if not xs or not ys:
            return 1
        key = (a, b) if a < b else (b, a)
        total = self.scores.get(key, 0)
        if not total:
            total = 1
            for i, j in self._places(xs, ys):
                total += self._weigh(xs[i], ys[j])
            if len(self.scores) >= self.REMEMBERED:
                self.scores.clear()
            self.scores[key] = total
        return total

    def _weigh(self, x: int, y: int) -> int:
        """The most node pairs of two runs."""
        (symbol, these), (other, those) = self.made_of[x], self.made_of[y]
        total = 0
        if symbol == other:
            for i in range(min(len(these), len(those))):
                total += self._score(these[i], those[i])
        return total

    def _weigher(self, kinds: list[int]) -> Callable[[int], np.ndarray]:
        """``_weigh`` of a run with each of many others."""
        shapes: dict[str, dict[int, int]] = {}  # by symbol, numbered
        nth: dict[str, list[tuple[list[int], list[int]]]] = {}  # the same of the first, second, .. shapes: whose they are, and which
        for k, kind in enumerate(kinds):
            symbol, those = self.made_of[kind]
            numbers, lists = shapes.setdefault(symbol, {}), nth.setdefault(symbol, [])
            for i, shape in enumerate(those):
                if i == len(lists):
                    lists.append(([], []))
                lists[i][0].append(k)
                lists[i][1].append(numbers.setdefault(shape, len(numbers)))
        at = {symbol: [(np.array(whose), np.array(which)) for whose, which in lists] for symbol, lists in nth.items()}
        known: dict[int, np.ndarray] = {}
        held = 0

        def weights(x: int) -> np.ndarray:
            nonlocal held
            symbol, these = self.made_of[x]
            total = np.zeros(len(kinds), np.int32)
            if symbol not in at:
                return total
            for shape, (whose, which) in zip(these, at[symbol]):
                if shape not in known:
                    scores = np.array([self._score(shape, other) for other in shapes[symbol]], np.int32)
                    if held > CACHED:
                        known.clear()
                        held = 0
                    held += len(scores)
                    known[shape] = scores
                total[whose] += known[shape][which]
            return total

        return weights

    def _places(self, xs: tuple[int, ...] | list[int], ys: tuple[int, ...] | list[int]) -> list[tuple[int, int]]:
        if len(xs) == len(ys) and [self.made_of[x][0] for x in xs] == [self.made_of[y][0] for y in ys]:
            return [(i, i) for i in range(len(xs))]
        return common_sequence(xs, ys, self.HELD, self._weigh, self._weigher)

    def aligned(self, xs: list[list[Node]], ys: list[list[Node]]) -> list[tuple[list[Node], list[Node]]]:
        """Pairs of runs, in order."""
        if [x[0].symbol for x in xs] == [y[0].symbol for y in ys]:
            return list(zip(xs, ys))
        return [(xs[i], ys[j]) for i, j in self._places([self._run(x) for x in xs], [self._run(y) for y in ys])]

    def texts(self, page: Node, pivot: Node) -> list[tuple[Node, Node]]:
        """Pairs of text nodes whose ancestors are all paired."""
        self._next_page()
        out: list[tuple[Node, Node]] = []
        todo = [(page, pivot)]
        while todo:
            a, b = todo.pop()
            if a.tag == "#":
                out.append((a, b))
                continue
            for x, y in self.aligned(self._runs(a), self._runs(b)):
                todo += zip(x, y)
        return out


# Tables up to ``SMALL`` cells take less time as lists; the places are the same.  Each level of a larger one keeps ``KEPT`` rows, a row
# counts for ``ROW`` cells at least among those held, and up to ``CACHED`` weights are remembered.
SMALL = 1_000
KEPT, ROW, CACHED = 16, 1_000, 4_000_000


def _equal(x: Hashable, y: Hashable) -> int:
    return int(x == y)


def _one_by_one(weigh: Callable[[Any, Any], int], kinds: list[Any]) -> Callable[[Any], np.ndarray]:
    return lambda x: np.array([weigh(x, y) for y in kinds], np.int32)


def common_sequence(
    left: Sequence[Hashable], right: Sequence[Hashable], most: int, weigh: Callable[[Any, Any], int] = _equal, weigher: Callable[[list[Any]], Callable[[Any], np.ndarray]] | None = None
) -> list[tuple[int, int]]:
    """Places of a heaviest common sequence; without weights, of a longest one.

    ``weigh`` says what a pair weighs: 0 if it can't be one, and most where both are equal; ``weigher``, given many, says the same of one
    and each of them.  Of several heaviest sequences it is one and the same whatever ``most``, the number of table cells whose way
    back is held at a time: rows of a larger table are computed again.  Time grows as the product of the lengths between equal ends.
    """
    hi = 0
    while hi < min(len(left), len(right)) and left[-1 - hi] == right[-1 - hi]:
        hi += 1
    lo = 0
    while lo < min(len(left), len(right)) - hi and left[lo] == right[lo]:
        lo += 1
    xs, ys = left[lo : len(left) - hi], right[lo : len(right) - hi]
    if not xs or not ys:
        middle = []
    elif len(xs) * len(ys) <= min(most, SMALL):
        middle = _small_table(xs, ys, weigh)
    else:
        kinds = list(dict.fromkeys(ys))
        middle = _large_table(xs, ys, kinds, weigher(kinds) if weigher else _one_by_one(weigh, kinds), most)
    ends = [(len(left) - k, len(right) - k) for k in range(hi, 0, -1)]
    return [(i, i) for i in range(lo)] + [(i + lo, j + lo) for i, j in middle] + ends


def _small_table(xs: Sequence[Hashable], ys: Sequence[Hashable], weigh: Callable[[Any, Any], int]) -> list[tuple[int, int]]:
    table = [[0] * (len(ys) + 1)]
    weights = []
    for x in xs:
        weights.append([weigh(x, y) for y in ys])
        above, row = table[-1], [0]
        for j, w in enumerate(weights[-1]):
            row.append(max(row[j], above[j + 1], above[j] + w))
        table.append(row)
    i, j, out = len(xs), len(ys), []
    while i and j:
        w = weights[i - 1][j - 1]
        if w and table[i][j] == table[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _large_table(xs: Sequence[Hashable], ys: Sequence[Hashable], kinds: list[Any], weigh: Callable[[Any], np.ndarray], most: int) -> list[tuple[int, int]]:
    """As ``_small_table``, a row at a time, with memory for ``most`` cells and ``KEPT`` rows a level; ``kinds`` are the different ``ys``."""
    numbers = {y: k for k, y in enumerate(kinds)}
    places = np.array([numbers[y] for y in ys])
    known: dict[Hashable, np.ndarray] = {}

    def weights(x: Hashable, width: int) -> np.ndarray:
        if x not in known:
            found = weigh(x)
            if len(known) * len(kinds) > CACHED:
                known.clear()
            known[x] = found
        return known[x][places[:width]]

    def below(row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = row[:-1] + w
        new = np.concatenate([row[:1], np.maximum(row[1:], met)])
        return np.maximum.accumulate(new), met

    out: list[tuple[int, int]] = []

    def back(first: int, last: int, row: np.ndarray) -> int:
        """Go back from the end of row ``last`` to row ``first``, which is given; the column reached."""
        j = len(row) - 1
        if last - first == 1 or (last - first) * max(j, ROW) <= most:
            up, take = [], []
            for x in xs[first:last]:
                w = weights(x, j)
                new, met = below(row, w)
                up.append(np.packbits(new[1:] == row[1:]))
                take.append(np.packbits((w > 0) & (new[1:] == met)))
                row = new
            i = last - first
            while i and j:
                at, bit = (j - 1) >> 3, 0x80 >> ((j - 1) & 7)
                if take[i - 1][at] & bit:
                    i, j = i - 1, j - 1
                    out.append((first + i, j))
                elif up[i - 1][at] & bit:
                    i -= 1
                else:
                    j -= 1
            return j
        step = -(-(last - first) // KEPT)
        starts = list(range(first, last, step))
        kept = [row]
        for i in range(first, starts[-1]):
            row, _ = below(row, weights(xs[i], j))
            if (i + 1 - first) % step == 0:
                kept.append(row)
        del row
        while starts and j:
            start = starts.pop()
            j = back(start, min(start + step, last), kept.pop()[: j + 1])
        return j

    back(0, len(xs), np.zeros(len(ys) + 1, np.int32))
    return out[::-1]
