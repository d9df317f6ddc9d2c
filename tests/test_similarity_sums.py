import random
import time

import models
import numpy as np
import pytest

from plumbline.functions.similarity import Records
from plumbline.functions.similarity_sums import similarity_sum
from plumbline.operators import matching
from plumbline.plans.scale import checkpointed


def made(rng, rows, columns, longest):
    texts = [["".join(rng.choice("abc é-\0") for _ in range(rng.randint(0, longest))) for _ in range(rows)] for _ in range(columns)]
    return texts, [[models.words(t) for t in column] for column in texts]


@pytest.mark.parametrize("seed", range(24))
def test_sums_are_those_of_all_pairs(seed):
    """Several columns, copies, empty texts, texts beyond a machine word, any order of ids; one side or two."""
    rng = random.Random(seed)
    rows = rng.choice([2, 9, 60])
    texts, words = made(rng, rows, rng.choice([1, 2]), rng.choice([3, 15, 40, 64, 75]))
    n, ids = np.array([rng.choice([1, 1, 4]) for _ in range(rows)]), np.array(rng.sample(range(1000), rows))
    records, every = Records(texts, words), np.arange(rows)
    left, right = every[: rows // 2], every[rows // 2 :]
    i, j = np.triu_indices(rows, 1)
    across = (i < rows // 2) & (j >= rows // 2)
    flip = ids[i] > ids[j]
    _, score = records.similar(np.where(flip, j, i), np.where(flip, i, j), None)
    weighted = n[i] * n[j] * score
    assert similarity_sum(texts, words, n, ids, every) == pytest.approx(weighted.sum(), rel=1e-12)
    assert similarity_sum(texts, words, n, ids, left, right) == pytest.approx(weighted[across].sum(), rel=1e-12)


@pytest.mark.parametrize("part, grid", [(None, 256), (40, 256), (40, 5), (1000, 5)])
def test_group_similarity_against_plain_code(spark, monkeypatch, part, grid):
    monkeypatch.setattr(matching, "GRID", grid)
    rng = random.Random(4)
    rows = [(i, f"{rng.choice(['ann', 'anna', 'bob'])} {rng.choice(['lee', 'li', 'smith', ''])}{rng.randint(1, 90)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a string")
    texts = matching.distinct_texts(df, ["a"], "id")
    texts = checkpointed(texts.withColumn("grp", texts["first_row"] % 2 * (texts["first_row"] % 5)))
    got = {r["grp"]: (r["size"], r["match_score"]) for r in matching.group_similarity(texts, "grp", 1, part).collect()}
    grouped = {}
    for r in texts.collect():
        grouped.setdefault(r["grp"], []).append((r["first_row"], r["t0"], r["n"]))
    assert set(got) == set(grouped)
    for key, members in grouped.items():
        members.sort()
        size, total = sum(n for *_, n in members), sum(n * (n - 1) / 2 * 100 for *_, n in members)
        total += sum(n * m * models.alike(a, b) for x, (_, a, n) in enumerate(members) for _, b, m in members[x + 1 :])
        assert got[key][0] == size
        assert got[key][1] == pytest.approx(total / (size * (size - 1) / 2) if size > 1 else 100.0, abs=0.0051)


def test_grids_are_many_times_faster_than_lists_of_pairs():
    names = [f"customer {k}" for k in random.Random(1).sample(range(100_000, 200_000), 1500)]
    texts, words, n, ids = [names], [[models.words(t) for t in names]], np.ones(1500), np.arange(1500)
    start = time.perf_counter()
    found = similarity_sum(texts, words, n, ids, ids)
    middle = time.perf_counter()
    i, j = np.triu_indices(1500, 1)
    _, score = Records(texts, words).similar(i, j, None)
    assert found == pytest.approx(score.sum(), rel=1e-12)
    assert 2 * (middle - start) < time.perf_counter() - middle
