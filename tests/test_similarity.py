import random

import models
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.similarity import Records, Texts, text_similarity
from plumbline.functions.text import is_blank, is_mixed_case, phonetic_code, phonetic_key, sorted_tokens

TEXT = st.text(alphabet="abcdeé _-xy1Ж", max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_ratios(a, b):
    texts = Texts([a, b])
    i, j = np.array([0]), np.array([1])
    assert texts.ratio(i, j)[0] == models.ratio(a, b)
    assert texts.window_ratio(i, j)[0] == models.window_ratio(a, b)
    assert texts.ratio_bound(i, j)[0] >= texts.ratio(i, j)[0]


@pytest.mark.parametrize("sizes", [(63, 64), (64, 64), (65, 64), (70, 20), (150, 140)])
def test_long_texts(sizes):
    rng = random.Random(1)
    for _ in range(10):
        a, b = ("".join(rng.choice("abcd ") for _ in range(n)) for n in sizes)
        texts = Texts([a, b])
        i, j = np.array([0, 1]), np.array([1, 0])
        assert list(texts.ratio(i, j)) == [models.ratio(a, b)] * 2
        assert list(texts.window_ratio(i, j)) == [models.window_ratio(a, b), models.window_ratio(b, a)]


def test_window_bound_and_very_long_texts():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (0, 1, 30, 64, 65, 120, 400, 500)]
    prepared = Texts(texts)
    i, j = np.triu_indices(len(texts))
    window = prepared.window_ratio(i, j)
    assert (prepared.window_bound(i, j, prepared.common(i, j)) >= window).all()
    assert list(window) == [models.window_ratio(texts[a], texts[b]) for a, b in zip(i, j)]


def test_threshold_drops_only_what_is_below():
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), rng.choice(["", "ann", "anna", "bob"])) for _ in range(60)]
    columns = list(zip(*rows))
    records = Records(columns, [[models.words(t) for t in c] for c in columns])
    i, j = np.triu_indices(len(rows), 1)
    for threshold in (30, 60, 85, 100):
        at, score = records.similar(i, j, threshold)
        found = {(i[p], j[p]): s for p, s in zip(at, score)}
        expected = {
            (a, b): models.alike_rows(rows[a], rows[b])
            for a, b in zip(i, j)
            if models.alike_rows(rows[a], rows[b]) >= threshold
        }
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)


def test_known_boundary():
    assert models.alike("Jane Doe", "Jane D.") == pytest.approx(84.8)
    assert models.window_ratio("abc", "xxab") == 80


TEXTS = ["", " ", "\t\n", " ", "Jane Doe", "jane", "JANE", "mcDonald Ltd", "ATM Withdrawal", "O'Brien", "o'brien", "É É", "éa",
         "x1y", "X1Y", "Zack Phaggh", "Bookkeeper", "aeiou", "Caechoe", "PHAGH", "Ångström-Lab_a b", "a" * 70, "ß", "Straße 5",
         "JANE doe", "A_b", "A_B", "it's", "It's", "It'S", None]


def test_text_functions(spark):
    rng = random.Random(3)
    random_texts = ["".join(rng.choice("aAbBcCzZpPhHgGkK 'é1_-") for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    texts = TEXTS + random_texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "t", F.expr(is_blank("t")).alias("blank"), F.expr(is_mixed_case("t")).alias("mixed"),
        phonetic_code(F.col("t")).alias("code"), phonetic_key([F.col("t"), F.lit("")]).alias("key"),
        sorted_tokens(F.lower("t")).alias("words"),
    ).collect()
    for row in rows:
        t = row["t"]
        if t is None:
            assert row["blank"] is None and row["code"] is None and row["key"] is None
            continue
        assert row["blank"] == (t.strip() == ""), repr(t)
        assert row["mixed"] == (t != t.lower() and t != t.upper() and t != t.title()), repr(t)
        assert row["code"] == models.phonetic(t), repr(t)
        assert row["key"] == (models.phonetic(t) if t else None), repr(t)
        assert row["words"] == models.words(t.lower()), repr(t)


def test_similarity_expression(spark):
    rng = random.Random(4)
    rows = [(rng.choice(TEXTS), rng.choice(TEXTS), rng.choice(TEXTS), rng.choice(TEXTS)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    score = text_similarity([(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))])
    for row in df.withColumn("score", score).collect():
        assert row["score"] == pytest.approx(models.alike_rows((row["a"], row["c"]), (row["b"], row["d"])))
