"""Conversation tries, personal data and collocations against plain code on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F

from plumbline.llm import collocations, crf, pii, prefixtrie
from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


# ---- conversation trie ----

CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, value int"


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)


def plain_trie(rows, attempt=0):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{attempt}:{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[-1] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for q, inside in members.items():
        below = [x for x in members if x[: len(q)] == q]
        children = [x for x in below if len(x) == len(q) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(inside) if len(full[c]) == len(q)).encode()).hexdigest()
        above = min(members[q[:-1]]) if q else None
        out.add((min(inside), len(q), above, len(inside), len(children), len(leaves), saved, ends))
    return out


def nodes_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert frame.columns == names
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def random_conversations(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randrange(1, most)):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["u", "a", None]), r.choice(["x", "yy", "", None, "é日本"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_random_conversations(spark, seed):
    r = random.Random(seed)
    convs = sorted({r.choice([0, 100, 200]) + r.randrange(60) for _ in range(60)} | {0, 300})
    rows = random_conversations(seed, convs, 9)
    rows += [(777, t, "u", "same") for t in range(40)] + [(778, t, "u", "same") for t in range(40)] + [(700, 0, "u", "same")]
    rows += rows[:7] + [(None, 0, "u", "x"), (10_000_000_000, 0, None, None), (901, 3, "u", "z" * 100_000)]
    assert nodes_of(prefixtrie.trie(conversations_of(spark, rows))) == plain_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    empty = conversations_of(spark, [(1, 0, "u", "x")]).limit(0)
    assert nodes_of(prefixtrie.trie(empty)) == set()
    rows = [(c, 0, "u", "x") for c in range(501, 560)]  # no conversation 500: most are left without a turn
    assert nodes_of(prefixtrie.trie(conversations_of(spark, rows))) == plain_trie(rows)


@pytest.mark.parametrize("weak", ["base", "digest"])
def test_trie_notices_fingerprints_that_agree(spark, monkeypatch, weak):
    rows = random_conversations(5, range(0, 30), 6)
    if weak == "base":  # a base of zero: a fingerprint tells of the last turn only
        strong = prefixtrie.base_of
        monkeypatch.setattr(prefixtrie, "base_of", lambda attempt: strong(attempt) if attempt else 0)
    else:
        strong = prefixtrie.digest_of
        same = F.unhex(F.lit("ab" * 32))
        monkeypatch.setattr(prefixtrie, "digest_of", lambda role, text, attempt: strong(role, text, attempt) if attempt else same)
    rows = [(c, i, role, text) for i, (c, _, role, text) in enumerate(rows)]  # no ties, whose order a digest decides
    assert nodes_of(prefixtrie.trie(conversations_of(spark, rows))) == plain_trie(rows)


def test_products_compose():
    base, r = prefixtrie.base_of(3), random.Random(3)
    symbols = [r.randrange(1, prefixtrie.PRIME) for _ in range(9)]
    run = lambda part: [prefixtrie.Product(base, x) for x in part]

    def value(part):
        total = prefixtrie.Product()
        for x in run(part):
            total = total.then(x)
        return total.value

    for h in range(5):  # another head before the turns behind the first h
        head = symbols[-h - 1 :]
        assert prefixtrie.rebuilt(value(symbols[:7]), value(symbols[:h]), value(head), 7 - h, base) == value(head + symbols[h:7])


def test_trie_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert nodes_of(QUERIES["op11_conversation_trie"](spark, SF)) == plain_trie(rows)


# ---- personal data ----


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(4)
    for signs in ("ab@.-_ ", "012.5 ", "0123456789 -", "+12 ().-3a", "a@b.c-1+2 5é٣日"):
        for _ in range(4000):
            text = "".join(r.choice(signs) for _ in range(r.randrange(30)))
            assert pii.base_spans(text) == plain_base(text), text
    for digits in ("4111111111111111", "4111 1111-1111 1111", "5500005555555559", "378282246310005"):
        assert pii.base_spans(f"x {digits}.") == plain_base(f"x {digits}.")
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "1 " * 150_000, "+1" + " " * 300_000):
        assert not pii.base_spans(long) or long.startswith("1.")


def some_field(r, words, labels=4):
    known = {f: i for i, f in enumerate(["edge", *sorted({f for w in words for f in crf.features(w)})])}
    draw = lambda *shape: np.array([r.gauss(0, 1) for _ in range(int(np.prod(shape)))]).reshape(shape)
    return crf.Field(("O", *"abcdef"[: labels - 1]), known, draw(5, len(known), labels), draw(labels, labels))


def score_of(field, words, path):
    around = [("edge",)] * 2 + [crf.features(w) for w in words] + [("edge",)] * 2
    rows = [field.scores_of(x) for x in around]
    total = sum(rows[t + 2 + off][o][path[t]] for t in range(len(words)) for o, off in enumerate(crf.OFFSETS))
    return total + sum(field.moves[a, b] for a, b in zip((0, *path), (*path, 0)))


def test_viterbi_and_its_cuts_against_all_paths():
    r = random.Random(6)
    words = ["a", "B.", "12", "x-1", "(at)", "Of", "+4", "..", "é"]
    for _ in range(30):
        field = some_field(r, words)
        field.moves[:] *= r.choice([0.1, 1, 3])  # weak moves: many words are cut out of the chain
        texts = [[r.choice(words) for _ in range(r.randrange(6))] for _ in range(5)]
        for text, (places, labels) in zip(texts, crf.Decoder(field).decode(texts)):
            found = [0] * len(text)
            for p, x in zip(places.tolist(), labels.tolist()):
                found[p] = x
            best = max(itertools.product(range(4), repeat=len(text)), key=lambda path: score_of(field, text, path))
            assert score_of(field, text, found) == pytest.approx(score_of(field, text, best))


def test_gradient_against_differences():
    r = random.Random(7)
    words = np.array([[1, 2, 3], [2, 2, -1], [3, -1, -1]])
    gold, lengths = np.array([[0, 1, 1], [2, 0, 0], [1, 0, 0]]), np.array([3, 2, 1])
    seen = np.array([[r.randrange(2) for _ in range(5)] for _ in range(4)], float)
    weights, moves = (np.array([r.gauss(0, 1) for _ in range(int(np.prod(s)))]).reshape(s) for s in ((5, 5, 3), (3, 3)))
    _, by_weight, by_move = crf.gradient(words, gold, lengths, seen, weights, moves, 0.3)
    for value, slope in ((weights, by_weight), (moves, by_move)):
        for place in itertools.islice(np.ndindex(value.shape), 0, None, 3):
            before = value[place]
            losses = []
            for step in (1e-5, -1e-5):
                value[place] = before + step
                losses.append(crf.gradient(words, gold, lengths, seen, weights, moves, 0.3)[0])
            value[place] = before
            assert slope[place] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-4)


def test_words_of_one_shape_share_their_features():
    known = ["", "x", "ab", "abc", "Ab", "ABC", "abcdef", "Éa", "aÉ", "12", "1" * 18, "1" * 25, "a1", "a-bc", "日本", "ǅa", "ß1", "x" * 70]
    r, field = random.Random(8), crf.Field(("O", "a"), {f: i for i, f in enumerate(["edge", "alpha", "lower", "title", "upper", "mixed"])}, np.zeros((5, 6, 2)), np.zeros((2, 2)))
    for _ in range(3000):
        word = r.choice(["", "(", "+"]) + "".join(r.choice(known) for _ in range(r.randrange(1, 4))) + r.choice(["", ".", ",", "%%"])
        if word:
            decoder = crf.Decoder(field)
            other = re.sub("[a-wyz]", "x", word)
            assert decoder.rows_of([other, word]) == [decoder._row(crf.features(w)) for w in (other, word)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


HELD_OUT = [
    ("You may call 555-310-9921 tomorrow", "phone", "555-310-9921"),
    ("Telephone: (303) 555-0148 office", "phone", "(303) 555-0148"),
    ("mein Telefon 0172 9988776 ist", "phone", "0172 9988776"),
    ("tél. 06.98.76.54.32 svp", "phone", "06.98.76.54.32"),
    ("write to mary dot jones at sample dot org soon", "email", "mary dot jones at sample dot org"),
    ("mail peter.pan (at) neverland.com now", "email", "peter.pan (at) neverland.com"),
    ("email tom [at] site [dot] net", "email", "tom [at] site [dot] net"),
    ("SSN: 321-54-9876 given", "id", "321-54-9876"),
    ("IBAN DE02 1203 0000 0000 2020 51 thanks", "id", "DE02 1203 0000 0000 2020 51"),
    ("the iban GB82 WEST 1234 5698 7654 32", "id", "GB82 WEST 1234 5698 7654 32"),
]


def found_of(spark, field, texts):
    docs = spark.createDataFrame([(i, t, "old", 5) for i, t in enumerate(texts)], "doc_id long, text string, spans string, `start` int")
    frame = pii.find(docs, field)
    assert frame.columns == ["doc_id", "text", "start", "spans"]
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in frame.collect()}


def test_held_out_lines(spark, field):
    found = found_of(spark, field, [t for t, _, _ in HELD_OUT])
    hits = sum((kind, text.index(span), text.index(span) + len(span), False) in found[i] for i, (text, kind, span) in enumerate(HELD_OUT))
    assert hits >= 8
    clean = ["The and of Inly, thatble is.", "on 2024-05-17 at 12:30", "pages 120-134", "version 3.12.4", "order 4785380592391138 was sent", "Licensed under CC BY-NC 4.0."]
    assert not any(found_of(spark, field, clean).values())


def test_odd_texts_of_personal_data(spark, field):
    texts = [None, "", " \n", "a@b.cd and a@b.cd", "a@b.cd and a@b.cd", "word " * 50_000 + "x@y.zz", "an at " * 20_000, "é日 +1 (521) 555-2373", "q" * 200_000]
    found = found_of(spark, field, texts)
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert [s[:3] for s in found[i] if s[3]] == plain_base(text or "")
    assert found_of(spark, field, ["x"])[0] == [] and pii.find(spark.createDataFrame([], "doc_id long, text string"), field).count() == 0
    assert not any(not s[3] for i in range(len(texts)) for s in found[i])


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op12_personal_data"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.BASE]


# ---- collocations ----


def plain_phrases(docs, least, longest):
    counts, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for d in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + d])) for i in range(len(words) - d + 1))
    out = set()
    kept = {k: n for k, n in counts.items() if n >= least and len(k[1]) > 1}
    for (lang, p), a in kept.items():
        holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        if any(x == lang and holds(q) and n >= a for (x, q), n in kept.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.add((lang, " ".join(p), a, l, r, totals[lang], score))
    return out


def random_texts(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "c", "dd", "é", "Hot", " x", "日", "q\x00", "z'z"]
    texts = []
    for _ in range(n):
        parts = [r.choices(words, [9, 6, 4, 3, 2, 20, 1, 1, 1, 1])[0] + r.choice([" ", "  ", " ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(25))]
        texts.append(("".join(parts), r.choice(["en", "en", "en", "fr", None, "und"])))
    return texts


@pytest.mark.parametrize("route_words,at_once,bits", [(600_000, 2_000_000, 24), (40, 60, 24), (7, 25, 4)])
def test_phrases_against_plain_code(spark, route_words, at_once, bits):
    texts = random_texts(route_words, 120) + [(None, "en"), ("", None), ("...", "en"), ("hot " * 3000, "en"), ("a b c dd a b c dd", "xx")] + [("Ab cd, ef", "xx")] * 9
    docs = spark.createDataFrame([(i, t, x, 1) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, n int").repartition(3)
    for least, longest in ((4, 5), (2, 3)):
        found = collocations.mine(docs, least, longest, route_words, at_once, bits)
        rows = [tuple(r) for r in found.select("lang", "phrase", "a", "l", "r", "n", "score").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain_phrases(texts, least, longest)


def test_ranks_ties_and_empty_tables(spark):
    rows = [("en", f"p{i:03}", 5 + i % 2, 1, 1, 9, i // 7) for i in range(200)] + [("fr", "é", 1, 1, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = sorted((r.lang, r.rank, r.phrase) for r in collocations.ranked(frame, 30, 4).collect())
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[6], -r[2], r[1]))[:30]
    assert got == [("en", i + 1, r[1]) for i, r in enumerate(want)] + [("fr", 1, "é")]
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "x")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    row = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    a, n, l, r = 123_456_789_012, 98_765_432_109_876, 123_456_789_013, 7_000_000_000_001
    frame = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert frame.select(F.expr(row)).first()[0] == 1000 * a * n // (l * r)


def test_word_hashes_are_those_of_spark(spark):
    words = ["a", "é日本", "x" * 100, "q\x00"]
    frame = spark.createDataFrame([("fr", w) for w in words], "lang string, word string")
    signed = [r[0] % 2**64 for r in frame.select(collocations.hash_column(F.col("lang"), F.col("word"), 3)).collect()]
    assert collocations.word_hash("fr", [w.encode() for w in words], 3) == signed
    assert signed[0] == xxhash.xxh64_intdigest(b"a", xxhash.xxh64_intdigest(b"3 fr", 42))


def test_another_seed_where_hashes_agree(spark, monkeypatch):
    strong, python = collocations.hash_column, collocations.word_hash
    calls = []

    def weak(lang, word, seed):
        calls.append(seed)
        return F.when(F.lit(seed == 0), F.length(word).cast("long")).otherwise(strong(lang, word, seed))

    monkeypatch.setattr(collocations, "hash_column", weak)
    monkeypatch.setattr(collocations, "word_hash", python)
    texts = random_texts(9, 60)
    found = collocations.mine(spark.createDataFrame(texts, "text string, lang string"), 3, 4)
    assert {tuple(r) for r in found.collect()} == plain_phrases(texts, 3, 4) and calls == [0, 1]


def test_routes_are_ranges():
    r = np.random.default_rng(3)
    windows = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    bounds = np.array(sorted({tuple(int(x) for x in r.integers(0, 4, 4)) for _ in range(20)}), np.uint64)
    want = [sum(tuple(b) <= tuple(int(w[i]) for w in windows) for b in bounds.tolist()) for i in range(500)]
    assert collocations.route_of(windows, bounds).tolist() == want


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_phrase_collocations"])
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.01"
    assert not differences(QUERIES[name](spark, sf).toArrow(), connect(sf).sql(ORACLES[name]).to_arrow_table())
