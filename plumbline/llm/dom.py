"""A forgiving HTML tree, and the alignment of two trees by simple tree matching."""

from __future__ import annotations

import html
import re

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes: an open element of the first kind, not beyond one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: A value in quotes begins right behind its equals sign; any other quote is a character like others.
_VALUE = r"=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=\s*+[^\s>\"'][^\s>]*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^\s/>]*)((?:{_VALUE}|[^>])*+)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_OTHER = re.compile(r"[^a-z]+")


class Node:
    """An element: its tag, the tokens of its class, id and role in small letters (what is no letter as one hyphen),
    and its children, which are nodes or texts."""

    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()):
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def label(self) -> str:
        return self.tag + "".join(f".{m}" for m in self.marks)


def marks_of(attributes: str) -> tuple[str, ...]:
    words: list[str] = []
    for found in _MARK.finditer(attributes):
        tokens = (found[2] or found[3] or found[4] or "").lower().split()
        words += [w for w in (_OTHER.sub("-", t).strip("-") for t in tokens) if w]
    return tuple(dict.fromkeys(words))


def parse(text: str) -> Node:
    """The tree of a page. Tags that are never closed end where their parent does; closing tags that close
    nothing are passed over; a block closes an open paragraph and what is open in it."""
    root = Node("#")
    stack, at, lowered = [root], 0, None
    while True:
        found = _TOKEN.search(text, at)
        stop = found.start() if found else len(text)
        if stop > at:
            stack[-1].children.append(text[at:stop])
        if not found:
            return root
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in BLOCKS:
            _close(stack, {"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        attributes = found[3] or ""
        node = Node(tag, marks_of(attributes) if "=" in attributes else ())
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            lowered = text.lower() if lowered is None and len(text.lower()) == len(text) else lowered
            end = lowered.find(f"</{tag}", at) if lowered is not None else _raw_end(text, tag, at)
            end = len(text) if end < 0 else end
            node.children.append(text[at:end])
            close = text.find(">", end)
            at = len(text) if close < 0 else close + 1
            continue
        stack.append(node)


def _raw_end(text: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}", re.I).search(text, at)
    return found.start() if found else -1


def _close(stack: list[Node], tags: set[str], beyond: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in beyond:
            return


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Shape:
    """A tree for alignment: like siblings are one repeated child; texts are those of all of them."""

    __slots__ = ("label", "children", "text")

    def __init__(self, label: str, children: list[Shape], text: str):
        self.label, self.children, self.text = label, children, text


def shape(node: Node) -> Shape:
    """The shape of a tree, without recursion: the siblings of a label, and all under them, are one."""
    top = Shape(node.label, [], "")
    stack: list[tuple[Shape, list[Node]]] = [(top, [node])]
    while stack:
        here, nodes = stack.pop()
        texts = [c for n in nodes if n.tag not in RAW for c in n.children if isinstance(c, str)]
        here.text = squeezed(" ".join(texts))
        below: dict[str, list[Node]] = {}
        for n in nodes:
            for child in n.children:
                if isinstance(child, Node):
                    below.setdefault(child.label, []).append(child)
        here.children = [Shape(label, [], "") for label in below]
        stack += zip(here.children, below.values())
    return top


def matched(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the most nodes that two trees share with the order of siblings and the labels on
    the way down kept, and the pairs of nodes of one such match. Without recursion; of two lists of siblings only
    the pairs of one label are kept, not a table of all."""
    if a.label != b.label:
        return 0, []
    done: dict[tuple[int, int], tuple[int, list[tuple[Shape, Shape]]]] = {}
    stack: list[tuple[Shape, Shape, list | None]] = [(a, b, None)]
    while stack:
        x, y, pairs = stack.pop()
        if pairs is None:
            places: dict[str, list[int]] = {}
            for j, child in enumerate(y.children):
                places.setdefault(child.label, []).append(j)
            pairs = [(i, j) for i, child in enumerate(x.children) for j in reversed(places.get(child.label, ()))]
            stack.append((x, y, pairs))
            stack += [(x.children[i], y.children[j], None) for i, j in pairs]
            continue
        chosen, count = _heaviest(pairs, [done[id(x.children[i]), id(y.children[j])][0] for i, j in pairs], len(y.children))
        done[id(x), id(y)] = (count + 1, [(x.children[i], y.children[j]) for i, j in chosen])
    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        todo += reversed(done[id(x), id(y)][1])
    return done[id(a), id(b)][0], found


def _heaviest(pairs: list[tuple[int, int]], weights: list[int], n: int) -> tuple[list[tuple[int, int]], int]:
    """The pairs of most weight that rise on both sides; ``pairs`` rise in their first place and, where that is the
    same, fall in their second."""
    best = [(0, -1)] * (n + 1)  # a tree of the best that ends before a place
    before = []
    for k, ((_, j), weight) in enumerate(zip(pairs, weights)):
        top, at = (0, -1), j
        while at > 0:
            top = max(top, best[at])
            at -= at & -at
        before.append(top[1])
        entry, at = (top[0] + weight, k), j + 1
        while at <= n:
            best[at] = max(best[at], entry)
            at += at & -at
    top, at = (0, -1), n
    while at > 0:
        top = max(top, best[at])
        at -= at & -at
    chosen, k = [], top[1]
    while k >= 0:
        chosen.append(pairs[k])
        k = before[k]
    return chosen[::-1], top[0]
