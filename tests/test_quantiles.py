import random

import numpy as np
import pytest

from plumbline.functions.columns import nan_as_null
from plumbline.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns(seed: int, n: int):
    rng = random.Random(seed)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(n)],
        "tied": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "third": [3.0 if rng.random() < 0.34 else rng.gauss(0, 1e6) for _ in range(n)],
        "wild": [rng.choice([1e300, -1e300, 0.0, rng.random()]) for _ in range(n)],
        "gaps": [None if rng.random() < 0.3 else float("nan") if rng.random() < 0.1 else rng.random() for _ in range(n)],
        "constant": [4.0] * n,
        "none": [None] * n,
    }


@pytest.mark.parametrize("settings", [{}, {"direct_rows": 0}, {"direct_rows": 0, "accuracy": 20, "gather_rows": 5}, {"direct_rows": 0, "accuracy": 50, "gather_rows": 100}])
def test_quantiles_match_numpy(spark, settings):
    data = columns(1, 3001)
    names = list(data)
    df = nan_as_null(spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` double" for c in names)).repartition(5))
    found = exact_quantiles(df, names, PROBS, **settings)
    assert found["none"] is None
    for name in names[:-1]:
        values = [v for v in data[name] if v is not None and v == v]
        np.testing.assert_allclose(found[name], np.quantile(values, PROBS), rtol=1e-12, err_msg=name)


def test_whole_numbers_and_single_row(spark):
    df = spark.createDataFrame([(5,)], "v int")
    assert exact_quantiles(df, ["v"], [0.25, 0.75]) == {"v": [5.0, 5.0]}
    assert exact_quantiles(df, ["v"], [0.25, 0.75], direct_rows=0) == {"v": [5.0, 5.0]}
    df = spark.range(1000).selectExpr("cast(id as decimal(10,2)) as d", "cast(id as short) as s")
    for direct in (0, 10_000):
        assert exact_quantiles(df, ["d", "s"], [0.25, 0.5], direct_rows=direct) == {"d": [249.75, 499.5], "s": [249.75, 499.5]}
    assert exact_quantiles(df, [], [0.5]) == {}


@pytest.mark.parametrize("settings", [{}, {"accuracy": 20, "gather_rows": 0}, {"accuracy": 20, "gather_rows": 5}, {"accuracy": 50, "gather_rows": 100}])
def test_group_quantiles_match_numpy(spark, settings):
    from plumbline.operators.group_quantiles import group_quantiles

    data, rng, probs = columns(4, 2500), random.Random(9), [0.0, 0.25, 0.9]
    data = {c: data[c] for c in ("tied", "third", "gaps", "none")}
    del data["gaps"][:5]
    data["gaps"] = data["gaps"] + [None] * 5
    names = list(data)
    keys = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(2)) for _ in range(2490)] + [("one", 0), ("two", 7), ("two", 7)] + [("c", 1)] * 7
    rows = [(*k, *v) for k, v in zip(keys, zip(*data.values()))]
    df = nan_as_null(spark.createDataFrame(rows, "g string, `h.x` int, " + ", ".join(f"`{c}` double" for c in names)).repartition(5))
    found = {(r["g"], r["h.x"]): r for r in group_quantiles(df, ["g", "h.x"], names, probs, **settings).collect()}
    assert set(found) == set(keys)
    for key, r in found.items():
        own = [row for row in rows if row[:2] == key]
        assert r["__rows"] == len(own)
        for i, name in enumerate(names):
            values = [row[2 + i] for row in own if row[2 + i] is not None and row[2 + i] == row[2 + i]]
            got = [r[f"__q{i}_{j}"] for j in range(len(probs))]
            if values:
                np.testing.assert_allclose(got, np.quantile(values, probs), rtol=1e-12, err_msg=f"{name} {key}")
            else:
                assert got == [None] * len(probs)
    assert group_quantiles(df.limit(0), ["g"], names, probs, **settings).count() == 0


def test_one_formula_at_every_size(spark):
    """Large and small tables, and groups, interpolate alike to the last digit."""
    from plumbline.operators.group_quantiles import group_quantiles

    rng = random.Random(12)
    df = spark.createDataFrame([(rng.uniform(-1e3, 1e3), "g") for _ in range(998)], "v double, g string")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    small = exact_quantiles(df, ["v"], probs)
    assert exact_quantiles(df, ["v"], probs, direct_rows=0) == small
    found = group_quantiles(df, ["g"], ["v"], probs).first()
    assert [found[f"__q0_{j}"] for j in range(5)] == small["v"]


def test_ranks_on_both_sides_of_an_edge(spark):
    """One rank may miss a bracket while the next one falls on its edge: every alignment of ranks and edges."""
    for n in (998, 1001, 1237):
        df = spark.range(n).selectExpr("cast(id * id as double) AS v")
        probs = [0.05 * i for i in range(1, 20)]
        found = exact_quantiles(df, ["v"], probs, direct_rows=0, accuracy=500)["v"]
        np.testing.assert_allclose(found, np.quantile(np.arange(n, dtype=float) ** 2, probs), rtol=1e-12)
