"""Top-k, extraction, cover trees, URL filters and shards against plain code; the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as driver
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import coverdedup, extraction, sharding, topk, urlfilter
from plumbline.llm.covertree import CoverTree, dual
from plumbline.llm.dom import Shape, matched, parse, shape
from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n_links string, rank int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF).toArrow(), connect(SF).sql(ORACLES[name]).to_arrow_table()) == []


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.partition("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(driver.queries())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)


ODD = [(1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 0.0]), (6, [])]


def plain_topk(rows, k):
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e3])
def test_topk_with_ties_and_odd_rows(spark, scale):
    r = random.Random(8)
    rows = [(i, [scale * r.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(100, 400)]
    table = vectors(spark, rows + rows[:5] + ODD)
    quantised = topk.quantised(table)
    usable = rows + [(2, [0.0, 0.0]), (6, [])]
    got = topk.search(quantised, quantised.where("vec_id % 100 = 0"), bins=8).collect()
    assert sorted(map(tuple, got)) == plain_topk(usable, 10)
    few = quantised.where("vec_id in (100, 101, 102)")
    assert topk.search(few, few.where("vec_id = 100")).count() == 2
    assert topk.search(few.limit(0), few.limit(0)).count() == 0


def clustered(seed=4, n=400, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    rows = [base[rng.integers(12)] + rng.normal(size=width) * rng.choice([0.0, 0.02, 0.1, 0.3]) for _ in range(n)]
    return np.array(rows, np.float32).astype(float)


def plain_links(m):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, True)
    root = np.arange(len(m))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return near.sum(axis=1) - 1, root
        root = new


def test_dual_traversal_counts_every_pair():
    m = clustered()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    n, _ = plain_links(m)
    ids, got, _ = dual(tree := CoverTree(np.arange(len(m)), unit), tree, 0.95).rows()
    assert dict(zip(ids.tolist(), got.tolist())) == {i: x for i, x in enumerate(n.tolist()) if x}
    a, b = CoverTree(np.arange(150), unit[:150]), CoverTree(np.arange(150, 400), unit[150:])
    total = np.zeros(400, int)
    for first, second in ((a, a), (b, b), (a, b)):
        ids, got, _ = dual(first, second, 0.95).rows()
        total[ids] += got
    assert (total == n).all()


def test_near_duplicate_vectors(spark, monkeypatch):
    m = clustered()
    table = vectors(spark, [(i + 10, v.tolist()) for i, v in enumerate(m)] + ODD + [(10, m[0].tolist())])
    monkeypatch.setattr(coverdedup.trees, "__defaults__", (64,))
    rows = {r.vec_id: r for r in coverdedup.near_duplicates(table).collect()}
    n, root = plain_links(m)
    assert len(rows) == len(m) + 6
    for i in range(len(m)):
        assert (rows[i + 10].n_links, rows[i + 10].component_id, rows[i + 10].kept) == (n[i], root[i] + 10, root[i] == i)
    assert all(rows[i].n_links == 0 and rows[i].kept for i in range(1, 7))
    assert coverdedup.near_duplicates(table.limit(0)).count() == 0


def test_blocks_are_not_copied_for_the_blocks_they_meet(spark, monkeypatch):
    m = clustered()
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    monkeypatch.setattr(coverdedup.trees, "__defaults__", (16,))
    found = coverdedup.links(table)[1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Sort" not in plan
    # a task adds up what its pairs of blocks tell of a vector
    rows = found.withColumn("task", F.spark_partition_id()).groupBy("task", "vec_id").count()
    assert rows.agg(F.max("count")).first()[0] == 1
    n, _ = plain_links(m)
    counted = {r.vec_id: r.n for r in found.groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    assert counted == {i: x for i, x in enumerate(n.tolist()) if x}


def test_packed_trees_and_repeated_ids(spark, monkeypatch):
    m = clustered().astype(np.float32)
    tree = CoverTree(np.arange(len(m)), coverdedup._unit(m))
    again = CoverTree.unpacked(tree.packed(m), coverdedup._unit)
    assert (again.ids == tree.ids).all() and (again.unit == tree.unit).all()
    assert all((x == y).all() for a, b in zip(tree.levels, again.levels, strict=True) for x, y in zip(a, b, strict=True))
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [5.0, 0.1])]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for most in (200_000, 0):  # repeated ids broadcast, and too many for it
        monkeypatch.setattr(coverdedup, "REPEATS", most)
        kept = coverdedup.vectors_of(few)
        assert kept.schema["v"].dataType.simpleString() == "array<float>"
        assert sorted(map(tuple, kept.select("vec_id", F.col("v").cast("string")).collect())) == [
            (1, "[0.0, 1.0]"), (2, "[0.0, 3.0]"), (4, "[5.0, 0.1]")
        ]


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li>a<li>b</ul></nav><div class='cookie-notice'>we use</div>"
    "<article><h1>A &amp; B</h1><p>One  <b>two<br>three<p>four &lt;five&gt;<script>var x='</p>'</script><div class=\"ad\">buy</div></article>"
    "<div id=comments><p>first!</p></div><footer>&copy; f</footer></body></html>"
)


def test_main_text():
    assert extraction.main_text(PAGE) == "A & B\nOne two three\nfour <five>"
    assert extraction.main_text(None) == "" and extraction.main_text("") == "" and extraction.main_text("plain &am words") == "plain &am words"
    assert extraction.main_text("<article><p>" + "x " * 200_000) == ("x " * 200_000).strip()
    assert extraction.main_text("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p title=it's>hello</p><p>one</p><p>don't lose</p></article>", "hello\none\ndon't lose"),
        ('<p class="a"">hello', "hello"),
        ('<p class="abc>hello</p><p>x</p>', "hello\nx"),
        ("<a href=/x?a=1&b='>t</a> u", "t u"),
        ("<div id='content-sidebar-wrap'><article><p>in</p></article></div>", "in"),
        ("<div class='page-with-sidebar sidebar'><article>in</article></div>", "in"),
        ("<article><h2 id=related-work class=notice>Related</h2><p>x</p><p class='social-science'>y</p><p class=ad>z</p></article>", "Related\nx\ny"),
        ("<article>a</article><div class='main-nav'>b</div><article>c</article>", "a\nc"),
    ],
)
def test_markup_and_marks(html, text):
    assert extraction.main_text(html) == text


def hosts_without_marks(pages=5):
    """Pages of two layouts without article, main or marks: boxes that never change around text that does. In the
    first the unchanging box has most of the text."""
    words = lambda kind, i, n: f"{kind} {i} " * n
    rows, want = [], []
    for i in range(pages):
        rows.append(
            f"<body><div class=k><p>{'We sell everything. ' * 60}</p></div><div class=x><h1>{words('head', i, 2)}</h1><p>{words('text', i, 20)}</p>"
            f"<div class=q>Read more here</div><p>{words('more', i, 9)}</p></div><div class=z>Imprint</div></body>"
        )
        want.append("\n".join(words(*w).strip() for w in (("head", i, 2), ("text", i, 20), ("more", i, 9))))
    return rows, want


def texts_of(spark, pages, host="h.org"):
    frame = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in extraction.extract(frame).orderBy("page_id").collect()]


def test_wrapper_decides_where_no_element_does(spark):
    pages, want = hosts_without_marks()
    assert texts_of(spark, pages) == want
    alone = [extraction.main_text(p) for p in pages]
    assert all(a != w for a, w in zip(alone, want))  # without the wrapper, all of these are wrong
    # pages of other layouts or that cannot be aligned teach too, and are taken by their own elements
    more = ["<body><section><article><p>Own</p></article></section>", "", "<p>just this"]
    assert texts_of(spark, pages + more) == [*want, "Own", "", "just this"]
    assert texts_of(spark, [pages[0]] * 4) == [alone[0]] * 4 and texts_of(spark, pages[:1]) == alone[:1]  # nothing varies


def test_wrapper_returns_all_like_sections(spark):
    texts = [[f"page {i} section {j} " * 20 for j in range(3)] for i in range(4)]
    pages = ["<body><div class=k>home</div>" + "".join(f"<div class=section><p>{t}</p></div>" for t in page) + "</body>" for page in texts]
    assert texts_of(spark, pages) == ["\n".join(t.strip() for t in page) for page in texts]


def test_deep_pages_and_long_rows_of_siblings(spark):
    deep = ["<div>" * 3000 + f"deep {i}" for i in range(3)]
    assert texts_of(spark, deep) == [f"deep {i}" for i in range(3)]
    rows = ["<body>" + "".join(f"<p>{i} {j}</p><div>{i} {j}</div>" for j in range(4000)) for i in range(3)]
    assert [t.count("\n") for t in texts_of(spark, rows)] == [7999] * 3


def by_pairs(pages):
    """Slots and template by aligning the trees of every two pages: for each path of labels whether its text ever
    varies, and on how many pages it is."""
    trees = [shape(parse(p)) for p in pages]
    varies, seen = set(), Counter()

    def paths(tree):
        stack, found = [(tree, (tree.label,))], {}
        while stack:
            node, path = stack.pop()
            found[id(node)] = path
            stack += [(c, (*path, c.label)) for c in node.children]
        return found

    named = [paths(t) for t in trees]
    for a, names in zip(trees, named):
        seen.update({names[id(n)] for n, _ in matched(a, a)[1] if n.text})
        for b in trees:
            varies |= {names[id(x)] for x, y in matched(a, b)[1] if x.text and y.text and x.text != y.text}
    return varies, seen


def test_evidence_is_that_of_all_pairs_of_pages(spark):
    import xxhash

    r = random.Random(11)

    def tree(depth, tags):
        inner = "".join(tree(depth - 1, tags) for _ in range(r.randrange(1, 4))) if depth else ""
        tag, mark = r.choice(tags)
        return f"<{tag}{mark}>{r.choice(['', 'same', 'same', f'text {r.randrange(3)}'])}{inner}</{tag}>"

    pages = []
    for _ in range(7):
        r2 = r.getstate()
        pages.append("<body>" + tree(3, [("div", ""), ("section", ""), ("div", " class=b")]) + "</body>")
        if r.random() < 0.3:
            r.setstate(r2)
    varies, seen = by_pairs(pages)

    def digest(path):
        out = xxhash.xxh64_intdigest(path[0])
        for label in path[1:]:
            out = xxhash.xxh64_intdigest(label, out)
        return out - (1 << 64) if out >> 63 else out

    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)
    rows = {x.path: x for x in extraction.evidence(frame).collect()}
    assert set(rows) == {digest(p) for p in seen}
    crossing = 0
    for path, n in seen.items():
        found = rows[digest(path)]
        assert found.n == n
        if path in varies:
            assert found.low != found.high
        else:  # a pair of trees whose siblings change places pairs fewer nodes
            crossing += found.low != found.high
    assert crossing <= 1 + len(seen) // 3


def test_simple_tree_matching_is_maximal():
    def size(a, b):
        if a.label != b.label:
            return 0
        best = {(-1, -1): 0}
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(x, y))
        return 1 + m[-1][-1] + best[-1, -1]

    r = random.Random(1)

    def tree(depth):
        return Shape(r.choice("ab"), [tree(depth - 1) for _ in range(r.randrange(4))] if depth else [], "")

    for _ in range(50):
        a, b = tree(3), tree(3)
        count, pairs = matched(a, b)
        assert count == size(a, b) == len(pairs)
    assert [c.tag for c in parse("<ul><li>a<li>b</ul><p>c<div>d").children] == ["ul", "p", "div"]


def test_matching_of_deep_and_wide_trees():
    def chain(n):
        tree = Shape("div", [], "x")
        for _ in range(n):
            tree = Shape("div", [tree], "")
        return tree

    assert matched(chain(3000), chain(2000))[0] == 2001
    wide = lambda n: Shape("ul", [Shape(f"l{i % n}", [], "") for i in range(n)], "")
    assert matched(wide(20_000), wide(15_000))[0] == 15_001


def test_extraction_keeps_rows_and_columns(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE, "t", "w", 5) for i in range(6)] + [(6, None, None, "t", "w", 5), (7, "x", "", "t", "w", 5), (0, "http://h0.org/0", PAGE, "t", "w", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, wrapper string, path int")
    found = extraction.extract(frame)
    assert found.columns == ["page_id", "url", "html", "path", "host", "wrapper", "text"]
    assert Counter((r.page_id, r.text) for r in found.collect()) == Counter((r[0], "" if not r[2] else "A & B\nOne two three\nfour <five>") for r in rows)
    assert extraction.extract(frame.limit(0)).count() == 0


def test_extraction_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_wrapper_extraction"](spark, SF).collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert r.text == "\n".join(p for p in plain if p) and r.n_chars == len(r.text)


def test_digest_array(tmp_path):
    strings = [f"host{i}.org/x".encode() for i in range(500)]
    array = urlfilter.mapped(urlfilter.DigestArray.packed(strings))
    assert array.probe([*strings, b"none", b""]).tolist() == [*range(500), -1, -1]
    assert urlfilter.mapped(urlfilter.DigestArray.packed([])).probe([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("most", [200_000, 2])
def test_url_verdicts(spark, most):
    entries = [("org/", "allow", True), ("example.org/es/", "block", True), ("com/", "block", True), ("com/fr/", "allow", True), ("bad.net", "block", False), (None, "block", True)]
    known = spark.createDataFrame(entries + entries[:1], "key string, verdict string, rule boolean")
    cases = {
        "http://a.EXAMPLE.org/es/1?x": ("org/".join(["example.", ""]) + "es/", "block"), "https://org/es/": ("org/", "allow"), "x://notorg/": (None, "allow"),
        "http://a.org": (None, "allow"), "http://a.com/fr/": ("com/fr/", "allow"), "http://a.com/fr": ("com/", "block"), "http://www.bad.net/p#q": (None, "block"),
        None: (None, "allow"), "bad.net/": (None, "allow"), "http://?q": (None, "allow"), "": (None, "allow"),
    }
    rows = [(i, u, "old") for i, u in enumerate(cases)] * 2
    got = urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, host string"), known, shard_entries=most).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))
    assert next(r for r in got if r.page_id == 0).host == "a.example.org"


def test_best_fit_is_that_of_a_plain_scan():
    r = random.Random(6)
    for _ in range(20):
        sizes = sorted((r.randrange(1, 120) for _ in range(1500)), reverse=True)
        rooms, bins = [], []
        for s in sizes:
            fit = min(((room, i) for i, room in enumerate(rooms) if room >= s), default=None)
            at = fit[1] if fit else len(rooms)
            if fit is None:
                rooms.append(max(100, s))
            rooms[at] -= s
            bins.append(at)
        assert sharding.best_fit(sizes, 100) == bins


def test_shards(spark):
    texts = [None, "", "x" * 50_000, "é"] + ["copy of it"] * 300 + [f"text {i} " * (i % 40) for i in range(500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1), (5, texts[5], 1)], "doc_id long, text string, shard int")
    rows = sharding.shard(docs, lots=8, groups=100).collect()
    assert len(rows) == len(texts) + 2
    by, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            by[text].add(r.shard)
            assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert all(len(s) == 1 for s in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shard_query_is_even(spark):
    rows = QUERIES["op9_best_fit_shards"](spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(rows) == 8 and max(r.n for r in rows) <= 1.02 * min(r.n for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        count = docs.count()
        assert docs.columns == columns and count <= before, name
        if name in ("language ID", "secret scans"):  # all of these are clean
            assert count == before
        before = count
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == kept
    totals = defaultdict(int)
    for r in pieces:
        totals[r.doc_id, r.doc_tokens] += r.length
    assert all(n == tokens for (_, tokens), n in totals.items())


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
