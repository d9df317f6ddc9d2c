"""Main text of web pages by wrappers that are induced from all pages of a host."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import look_up
from plumbline.llm.dom import BLOCKS, RAW, Node, parse, squeezed
from plumbline.llm.urlfilter import host_of
from plumbline.plans.scale import checkpointed

#: A node with the same text on at least so many pages of a host, not all the same page, is template.
TEMPLATE_PAGES = 3
#: A wrapper names a node at most so many containers deep; what lies deeper counts for the last of them.
DEEPEST = 64
#: Nodes of hosts that a task counts before it hands them on.
NODES_KEPT = 100_000
# fixed values: elements and marks (class, id or role) of what is no main text
NOT_TEXT = frozenset("script style noscript template iframe object embed svg canvas button select option input textarea label head title nav menu header footer aside form dialog noembed noframes xmp".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe subscription signup login share sharing "
    "social comment comments reply replies respond disqus related recommended widget toolbar pagination pager skip search contentinfo complementary".split()
)
#: Words that may stand beside a marked one in a compound: a main-nav is a nav, a content-sidebar-wrap is none.
BESIDE = frozenset("site main page top bottom left right primary secondary global list box bar block area section links form policy".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = ("article", "main")
#: Elements that a wrapper may name.
CONTAINERS = frozenset("#  html body article main section div center blockquote table tbody tr td".split())
EVIDENCE = "host string, path long, low long, high long, n long, chars long, page_low long, page_high long, chain array<struct<node:long,home:long,depth:int>>"


def marked(node: Node) -> bool:
    """Whether a whole token of a node's class, id or role says that it is no main text; never for headings."""
    if node.tag in HEADINGS or node.tag in ("html", "body", *ROOTS):
        return False
    return any(t in MARKED or (not (words := set(t.split("-"))).isdisjoint(MARKED) and words <= MARKED | BESIDE) for t in node.marks)


class Page:
    """A parsed page: for every element the digest of its path of labels, whether it is no main text, and the digest
    of the texts that stand right in the elements of its path."""

    def __init__(self, html: str | None):
        self.root = parse(html or "")
        self.paths: dict[int, int] = {}
        self.texts: dict[int, list[str]] = {}
        self.out: set[int] = set()
        self.chains: dict[int, tuple] = {}
        holds = self._holding()
        root = xxhash.xxh64_intdigest(self.root.label)
        stack = [(self.root, root, ((root, root, 0),))]
        while stack:
            node, path, chain = stack.pop()
            self.paths[id(node)] = path
            if node is not self.root and (node.tag in NOT_TEXT or node.tag in RAW or (marked(node) and id(node) not in holds)):
                self.out.add(id(node))
                continue
            self.chains[path] = chain
            texts = [c for c in node.children if isinstance(c, str) and not c.isspace()]
            if texts:
                self.texts.setdefault(path, []).extend(texts)
            for child in node.children:
                if isinstance(child, Node):
                    below = xxhash.xxh64_intdigest(child.label, path)
                    down = chain
                    if child.tag in CONTAINERS and len(chain) < DEEPEST:
                        # the nearest article or main element at or above a node is taken in its place
                        home = chain[-1][1] if chain[-1][2] and child.tag not in ROOTS else below
                        down = (*chain, (below, home, 1 if child.tag in ROOTS else chain[-1][2]))
                    stack.append((child, below, down))
        self.digests = {path: xxhash.xxh64_intdigest(squeezed(" ".join(t))) for path, t in self.texts.items()}

    def _holding(self) -> set[int]:
        """Nodes that hold an article or main element: no mark takes them out."""
        order, stack, parents = [], [self.root], {}
        while stack:
            node = stack.pop()
            order.append(node)
            for child in node.children:
                if isinstance(child, Node):
                    parents[id(child)] = node
                    stack.append(child)
        holds: set[int] = set()
        for node in reversed(order):
            if (node.tag in ROOTS or id(node) in holds) and id(node) in parents:
                holds.add(id(parents[id(node)]))
        return holds

    def blocks(self, node: Node, template: dict[int, int] | None = None) -> list[str]:
        """The texts of the blocks under a node in page order, without what is no main text or template."""
        out: list[str] = []
        words: list[str] = []

        def flush() -> None:
            text = squeezed("".join(words))
            if text:
                out.append(text)
            words.clear()

        stack: list[object] = [(node, None)]
        while stack:
            here, kept = stack.pop()
            if here is None:
                flush()
            elif isinstance(here, str):
                words.append(here if kept else " ")
            elif here.tag == "br":
                words.append(" ")
            elif here is node or id(here) not in self.out:
                block = here.tag in BLOCKS
                if block:
                    flush()
                    stack.append((None, None))
                path = self.paths.get(id(here))
                own = not template or path not in template or template[path] != self.digests.get(path)
                stack.extend((c, own) for c in reversed(here.children))
        flush()
        return out

    def at(self, wrapper: int) -> list[Node]:
        """The nodes of a path in page order, outside what is no main text."""
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if self.paths.get(id(node)) == wrapper:
                found.append(node)
                continue
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and id(c) not in self.out]
        return found

    def named(self) -> list[Node]:
        """The outermost article elements in page order, else the main elements."""
        for tag in ROOTS:
            found, stack = [], [self.root]
            while stack:
                node = stack.pop()
                if node.tag == tag:
                    found.append(node)
                    continue
                stack += [c for c in reversed(node.children) if isinstance(c, Node) and id(c) not in self.out]
            if found:
                return found
        return []

    def densest(self) -> Node:
        """From the root down to the child that holds over two thirds of the text, as long as there is one."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [c for c in node.children if isinstance(c, Node) and id(c) not in self.out]
        size: dict[int, int] = {}
        for node in reversed(order):
            size[id(node)] = sum(len(c) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
        here = self.root
        while True:
            heavy = [c for c in here.children if isinstance(c, Node) and c.tag in BLOCKS and id(c) in size]
            child = max(heavy, key=lambda c: size[id(c)], default=None)
            if child is None or child.tag in ("p", "li", "pre") or 3 * size[id(child)] < 2 * size[id(here)]:
                return here
            here = child


def main_text(html: str | None, wrapper: int | None = None, template: dict[int, int] | None = None) -> str:
    """The main text of a whole page; empty for a null or empty one.

    The nodes that the host's wrapper names come first, without what is template there; where it names none with
    text, the page's article or main elements, or else its densest block."""
    if not html:
        return ""
    page = Page(html)
    if wrapper is not None:
        nodes = page.at(wrapper)
        for known in (template, None):
            blocks = [b for n in nodes for b in page.blocks(n, known)]
            if blocks:
                return "\n".join(blocks)
    return "\n".join(b for n in page.named() or [page.densest()] for b in page.blocks(n))


def evidence(pages: DataFrame) -> DataFrame:
    """(host, path, ...) for every path of labels that holds text on a host's pages (host, html): the lowest and
    highest digest of its text, on how many pages and with how many characters, the lowest and highest digest of
    these pages, and the containers above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                whole = _signed(xxhash.xxh64_intdigest(html.encode("utf-8", "replace")))
                for path, digest in page.digests.items():
                    chars, digest = sum(map(len, page.texts[path])), _signed(digest)
                    old = kept.get((host, path))
                    if old is None:
                        kept[host, path] = [digest, digest, 1, chars, whole, whole, page.chains[path]]
                        continue
                    old[0], old[1] = min(old[0], digest), max(old[1], digest)
                    old[2], old[3] = old[2] + 1, old[3] + chars
                    old[4], old[5] = min(old[4], whole), max(old[5], whole)
                if len(kept) > NODES_KEPT:
                    yield _evidence(kept)
                    kept = {}
        yield _evidence(kept)

    texts = pages.select("host", F.col("html").cast("string").alias("html")).where("html <> ''")
    rows = texts.mapInArrow(count, EVIDENCE)
    return rows.groupBy("host", "path").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        F.min("page_low").alias("page_low"), F.max("page_high").alias("page_high"), F.first("chain").alias("chain"),
    )


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _evidence(kept: dict[tuple[str, int], list]) -> pa.RecordBatch:
    link = pa.struct([("node", pa.int64()), ("home", pa.int64()), ("depth", pa.int32())])
    chains = [[{"node": _signed(n), "home": _signed(h), "depth": d} for d, (n, h, _) in enumerate(row[6])] for row in kept.values()]
    columns = [pa.array([h for h, _ in kept], pa.string()), pa.array([_signed(p) for _, p in kept], pa.int64())]
    columns += [pa.array([row[i] for row in kept.values()], pa.int64()) for i in range(6)]
    names = ["host", "path", "low", "high", "n", "chars", "page_low", "page_high", "chain"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(chains, pa.list_(link))], names=names)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template) of the hosts whose pages tell a wrapper, from (host, html) of all their pages.

    In a tree whose like siblings are one, siblings have different labels, and simple tree matching of two such trees
    (``dom.matched``) pairs the nodes of equal paths of labels; so counting texts by path aligns every page with
    every other, and no host's pages have to meet. A path whose text varies is a slot. The wrapper is the deepest
    container that holds over two thirds of the characters in slots, or the nearest article or main element
    around it. Template are the paths whose text is the same on all of at least ``TEMPLATE_PAGES`` pages."""
    found = checkpointed(evidence(pages))
    slots = found.where("low <> high")
    totals = slots.groupBy("host").agg(F.sum("chars").alias("total"))
    nodes = slots.select("host", "chars", F.explode("chain").alias("c")).groupBy("host", "c.node").agg(
        F.sum("chars").alias("held"), F.first("c").alias("c")
    )
    heavy = nodes.join(totals, "host").where("3 * held > 2 * total AND c.depth > 0")
    chosen = heavy.groupBy("host").agg(F.max_by("c.home", F.struct("c.depth", "node")).alias("wrapper"))
    fixed = found.where(f"low = high AND n >= {TEMPLATE_PAGES} AND page_low <> page_high")
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("path", F.col("low").alias("text"))).alias("template"))
    return chosen.join(fixed, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``wrapper`` (the digest of a path of labels) and ``text`` to pages (page_id, url, html): the
    main text of each whole page, its blocks joined by line feeds. All pages of a host teach its wrapper, whatever
    their length or layout. Null pages have an empty text; pages without a host share the empty host's wrapper.
    Repeated rows are each extracted; pages nested to any depth are; an empty table gives an empty one. Columns of the
    three names are replaced."""
    kept = pages.drop("host", "wrapper", "text")
    keyed = kept.withColumn("host", host_of(kept["url"].cast("string")))
    known = checkpointed(wrappers(keyed.select("host", "html")))
    joined = look_up(keyed, known.withColumnRenamed("template", "__template"), ["host"])
    joined = joined.select(*[joined[c] for c in kept.columns], "host", "wrapper", "__template")
    at_html, columns = kept.columns.index("html"), joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen = [], {}
            for html, host, wrapper, fixed in zip(*[batch.column(i).to_pylist() for i in (at_html, *map(columns.index, ("host", "wrapper", "__template")))], strict=True):
                if host not in seen:
                    seen[host] = {x["path"] % 2**64: x["text"] % 2**64 for x in fixed or ()}
                texts.append(main_text(html, None if wrapper is None else wrapper % 2**64, seen[host]))
            kept_columns = [batch.column(i) for i, c in enumerate(columns) if c != "__template"]
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(texts, pa.string())], names=[*[c for c in columns if c != "__template"], "text"])

    fields = [f for f in joined.schema.fields if f.name != "__template"]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
