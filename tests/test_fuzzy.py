import random
from collections import Counter
from itertools import combinations

import models
import pytest

from plumbline.operators import fuzzy, matching
from plumbline.operators.phonetic import phonetic_groups
from plumbline.plans.duplicates import duplicate_members, duplicate_stats, find_duplicates
from plumbline.plans.scale import checkpointed


def names(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    first, last = ["Ann", "Anna", "Anne", "Anton", "bob", "Bobby"], ["Lee", "Leigh", "Li", "Smith", "Smyth", "Smithe"]
    made = []
    for _ in range(n):
        kind = rng.random()
        name = f"{rng.choice(first)} {rng.choice(last)}{rng.choice(['', ' jr', 's', f' {rng.randint(1, 40)}'])}"
        made.append((None if kind < 0.05 else "" if kind < 0.1 else name, rng.choice(["x", "X", "xy", None, "z"])))
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, a string, b string")


@pytest.mark.parametrize(
    "columns, part, heads, rounds, threshold",
    [(1, 1000, 200, 2, 85.0), (1, 7, 3, 2, 85.0), (2, 5, 2, 1, 80.0), (1, 6, 4, 0, 70.0), (2, 9, 50, 9, 90.0)],
)
def test_leaders_match_the_sequential_scan(spark, columns, part, heads, rounds, threshold):
    rows = [r[:columns] for r in names(columns + part, 160)]
    df = frame(spark, [(*r, None)[:2] for r in rows])
    texts = fuzzy.fuzzy_texts(df, ["a", "b"][:columns], "id", threshold, part, heads, rounds)
    leader_of = {r["first_row"]: r["leader"] for r in texts.collect()}
    expected = models.greedy_groups(rows, threshold)
    lowered = [tuple((v or "").lower() for v in r) for r in rows]
    first = {}
    for i, r in enumerate(lowered):
        first.setdefault(r, i)
    assert {i: leader_of[first[r]] for i, r in enumerate(lowered)} == expected


def test_groups_scores_and_members(spark):
    rows = [r[:1] for r in names(5, 150)]
    df = frame(spark, [(*r, None) for r in rows])
    expected = models.greedy_groups(rows, 85.0)
    members: dict = {}
    for row, leader in expected.items():
        members.setdefault(leader, []).append(row)
    members = {k: sorted(v) for k, v in members.items() if len(v) > 1}
    groups = {int(g["group_id"]): g for g in fuzzy.fuzzy_groups(df, ["a"], "id").collect()}
    assert groups.keys() == members.keys()
    for leader, ids in members.items():
        pairs = [models.alike_rows(rows[x], rows[y]) for x, y in combinations(ids, 2)]
        assert groups[leader]["size"] == len(ids)
        assert groups[leader]["match_score"] == pytest.approx(sum(pairs) / len(pairs), abs=0.0051)
    found = sorted((int(m["group_id"]), m["row_id"]) for m in fuzzy.fuzzy_members(df, ["a"], "id").collect())
    assert found == sorted((k, r) for k, ids in members.items() for r in ids)


def test_pairs_do_not_depend_on_the_cut(spark):
    rows = [r[:1] for r in names(6, 120)]
    df = frame(spark, [(*r, None) for r in rows])
    results = [
        sorted((p["a"], p["b"], round(p["similarity"], 6), p["n_a"], p["n_b"]) for p in fuzzy.fuzzy_pairs(df, ["a"], "id", 75.0, part).collect())
        for part in (1000, 4)
    ]
    assert results[0] == results[1] and results[0]
    texts = {}
    for i, (name,) in enumerate(rows):
        texts.setdefault((name or "").lower(), []).append(i)
    expected = set()
    for x, y in combinations(texts, 2):
        if models.block((x,)) == models.block((y,)) and models.alike(x, y) >= 75.0:
            expected.add(tuple(sorted((texts[x][0], texts[y][0]))))
    assert {(a, b) for a, b, *_ in results[0]} == expected


def test_dense_block_of_many_texts(spark):
    rows = [(f"Customer {i}",) for i in range(400)]
    df = frame(spark, [(*r, None) for r in rows])
    texts = fuzzy.fuzzy_texts(df, ["a"], "id", 85.0, part=50, heads=5)
    expected = models.greedy_groups(rows, 85.0)
    assert {r["first_row"]: r["leader"] for r in texts.collect()} == expected


@pytest.mark.parametrize("seated, worth", [(1_000_000, None), (60, True), (60, False)])
def test_dense_blocks_are_seated_and_not_compared_pair_by_pair(spark, monkeypatch, seated, worth):
    calls, settle = [], fuzzy._settle
    monkeypatch.setattr(fuzzy, "_settle", lambda *a: calls.append(1) or settle(*a))
    monkeypatch.setattr(fuzzy, "SEATED", seated, raising=False)
    if worth is not None:
        monkeypatch.setattr(fuzzy, "worth_a_round", lambda *a: worth, raising=False)
    rows = [(f"Customer {i * i % 4001}",) for i in range(300)]
    df = frame(spark, [(*r, None) for r in rows])
    texts = fuzzy.fuzzy_texts(df, ["a"], "id", 94.0, part=50, heads=5, rounds=1)
    expected = models.greedy_groups(rows, 94.0)
    assert {r["first_row"]: r["leader"] for r in texts.collect()} == expected
    assert bool(calls) == (worth is False)


def test_rounds_and_tasks_by_what_they_compare():
    assert fuzzy.worth_a_round(1000, 500, 1e12, 1.0)  # halved
    assert fuzzy.worth_a_round(313_335, 281_480, 11 * 281_480, 281_480**2 / 2)
    assert not fuzzy.worth_a_round(100_000, 99_800, 200 * 99_800, 99_800**2 / 2)
    assert fuzzy.take_in_tasks(5, 10**6, 10, 8) == 5
    assert fuzzy.take_in_tasks(700, 20_000, 10, 8) == 32 and fuzzy.take_in_tasks(700, 500_000, 1000, 8) == 500


def test_tiles_meet_every_pair_once(spark):
    df = spark.createDataFrame([("g" if i < 40 else f"h{i % 9}", i, 1) for i in range(90)], "grp string, first_row bigint, n bigint")
    tiled = matching.tiled(df, "grp", part=6)

    def pairs(tile):
        import pandas as pd

        ids, found = tile["first_row"].to_numpy(), []
        for i, j in matching.tile_pairs(tile, "grp"):
            found += [(min(a, b), max(a, b)) for a, b in zip(ids[i], ids[j])]
        return pd.DataFrame(found, columns=["a", "b"])

    seen = Counter((r["a"], r["b"]) for r in tiled.apply(pairs, "a bigint, b bigint").collect())
    group = lambda i: "g" if i < 40 else f"h{i % 9}"
    assert set(seen) == {(a, b) for a, b in combinations(range(90), 2) if group(a) == group(b)}
    assert set(seen.values()) == {1}


def test_phonetic_groups(spark):
    rows = [r[:1] for r in names(7, 100)]
    df = frame(spark, [(*r, None) for r in rows])
    expected: dict = {}
    for i, (name,) in enumerate(rows):
        if name:
            expected.setdefault(models.phonetic(name), []).append(i)
    expected = {k: v for k, v in expected.items() if len(v) > 1}
    for part in (1000, 3):
        found = {g["code"]: g for g in phonetic_groups(df, ["a"], "id", part).collect()}
        assert found.keys() == expected.keys()
        for code, ids in expected.items():
            pairs = [models.alike_rows(rows[x], rows[y]) for x, y in combinations(ids, 2)]
            assert found[code]["size"] == len(ids) and int(found[code]["group_id"]) == ids[0]
            assert found[code]["match_score"] == pytest.approx(sum(pairs) / len(pairs), abs=0.0051)


def test_small_example(spark):
    rows = [("John Smith", "john@test.com"), ("John Smith", "john@test.com"), ("Jane Doe", "jane@test.com"),
            ("Jane D.", "jane@test.com"), ("Bob Jones", "bob@test.com")]
    df = frame(spark, rows)
    found = find_duplicates(df, "id", text_columns=["a"], methods=("exact", "fuzzy")).collect()
    assert sorted((g["method"], g["group_id"], g["size"]) for g in found) == [("exact", "0", 2), ("fuzzy", "0", 2)]
    looser = find_duplicates(df, "id", text_columns=["a"], methods=("fuzzy",), threshold=84).collect()
    assert sorted((g["group_id"], g["size"], g["match_score"]) for g in looser) == [("0", 2, 100.0), ("2", 2, 84.8)]
    assert find_duplicates(df, "id", methods=("fuzzy",)).count() == 0  # nothing to compare
    stats = duplicate_stats(find_duplicates(df, "id", text_columns=["a"], methods=("exact", "fuzzy"))).first()
    assert (stats["total_groups"], stats["total_duplicate_records"], stats["avg_group_size"], stats["avg_match_score"]) == (2, 4, 2.0, 100.0)
    members = checkpointed(duplicate_members(df, "id", text_columns=["a"], methods=("exact", "fuzzy"), threshold=84))
    assert members.count() == 6


def test_heads_are_dealt_by_their_number():
    from plumbline.operators.fuzzy import seat_groups

    assert seat_groups(300 * 200, 1000) == 60 and seat_groups(0, 1000) == 1


def test_hot_keys_leave_before_the_shuffle(spark):
    from plumbline.plans import scale

    rows = spark.range(4000).selectExpr("if(id < 2000, 0, id) AS k", "id")
    keys = scale.checkpointed(rows.groupBy("k").count().withColumnRenamed("count", "n"))
    found = scale.join_counted_keys(rows, keys, ["k"], max_rows=1, written=True)
    assert found.count() == 4000 and found.where("k = 0").count() == 2000
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()
    assert scale.bounded(rows, 10) is None and scale.bounded(rows.limit(5), 10).count() == 5


def mixed_texts(seed: int, n: int) -> list[tuple]:
    """Texts of very different lengths and letters, many of them nearly alike."""
    rng = random.Random(seed)
    made = []
    while len(made) < n:
        letters = rng.choice(["abcdef ", "0123456789", "aceg13 ", "xyzbdf é", "ace bdf024135"])
        text = "ab" + "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 4, 7, 12, 20, 33, 70])))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            made.append(text[:at] + rng.choice(["", "a", " x", "9"]) + text[at + rng.randrange(2) :])
    return [(t, rng.choice([None, "", "ab", "abc" * rng.randrange(9)])) for t in made[:n]]


@pytest.mark.parametrize("columns, threshold, part", [(1, 85.0, 12), (1, 60.0, 5), (2, 85.0, 9), (2, 70.0, 20)])
def test_banded_tiles_find_the_pairs_of_all_tiles(spark, columns, threshold, part):
    rows = mixed_texts(columns * part, 220)
    df = frame(spark, [(a, "abz" if columns == 1 else b) for a, b in rows])
    texts = checkpointed(matching.distinct_texts(df, ["a", "b"][:columns], "id").withColumn("grp", models_group()))
    full = matching.tiled(texts, "grp", part, columns)
    banded = matching.tiled(texts, "grp", part, columns, threshold)
    pairs = lambda threshold: {
        (p["a"], p["b"]): p["similarity"] for p in matching.similar_pairs(texts, "grp", columns, threshold, part).collect()
    }
    every, found = pairs(None), pairs(threshold)
    assert found == {k: s for k, s in every.items() if s >= threshold} and found
    count = lambda t: t.rows.select(*t.KEYS).distinct().count()
    assert len(every) == texts.count() * (texts.count() - 1) // 2
    assert count(banded) <= count(full) and banded.rows.count() < full.rows.count()
    if columns == 1 and threshold >= 85:
        assert count(banded) < 0.8 * count(full) and banded.rows.count() < 0.6 * full.rows.count()


def models_group():
    from pyspark.sql import functions as F

    return F.lit("one")


def test_bounds_hold_for_every_pair(spark):
    """No pair's similarity exceeds what parts and rows are ruled out by."""
    from plumbline.operators import bands

    df = frame(spark, [(a, None) for a, _ in mixed_texts(3, 150)])
    texts = checkpointed(matching.distinct_texts(df, ["a"], "id").withColumn("grp", models_group()))
    every = matching.similar_pairs(texts, "grp", 1, None, 10)
    rows = checkpointed(matching.placed(texts, "grp", 1, 10)[0])
    ranges = bands.part_ranges(rows, 1)
    for threshold in (50.0, 85.0):
        near = {(r["first_row"], r["other"]) for r in rows.join(ranges, "hot").where(bands.can_reach(threshold, 1, None)).collect()}
        parts = {(r["part"], r["other"]) for r in bands.partners(ranges, 1, threshold).collect()}
        of = {r["first_row"]: r["part"] for r in rows.collect()}
        for p in every.where(f"similarity >= {threshold}").collect():
            assert (p["a"], of[p["b"]]) in near and (p["b"], of[p["a"]]) in near
            assert (of[p["a"]], of[p["b"]]) in parts and (of[p["b"]], of[p["a"]]) in parts
        assert len(near) < rows.count() * ranges.count()
