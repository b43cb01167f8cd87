"""Anchored alignment: exact within the budget, in order and complete beyond it, and honest about which it was."""

import random

import pytest
from pyspark.sql import functions as F
from test_whole_jobs import lcs

from quillon.operators import alignment as A


def two(spark, keys):
    """Frames of both sides from {key: (a, b)}."""
    make = lambda k: spark.createDataFrame([(key, i, t) for key, v in keys.items() for i, t in enumerate(v[k])], "k long, o long, t string")
    return make(0), make(1)


def judged(spark, keys, **more):
    """Aligned rows by key, after checking that every line is there once and that pairs are equal and in order."""
    left, right = two(spark, keys)
    by = {k: [] for k in keys}
    for r in A.align(left, right, "k", "o", "t", **more).collect():
        by[r["k"]].append(r)
    for k, rows in by.items():
        a, b = keys[k]
        assert sorted(r["l_order"] for r in rows if r["l_order"] is not None) == list(range(len(a)))
        assert sorted(r["r_order"] for r in rows if r["r_order"] is not None) == list(range(len(b)))
        same = sorted((r["l_order"], r["r_order"]) for r in rows if r["kind"] == "same")
        assert all(a[i] == b[j] for i, j in same) and [j for _, j in same] == sorted({j for _, j in same})
        assert all((r["kind"] == "removed") == (r["r_order"] is None) and (r["kind"] == "added") == (r["l_order"] is None) for r in rows)
    return by


def same(rows):
    return sum(r["kind"] == "same" for r in rows)


def pair(rnd, n, letters, unique=0.0):
    a = [f"u{i}" if rnd.random() < unique else rnd.choice(letters) for i in range(n)]
    b = [x for x in a if rnd.random() > 0.2]
    for _ in range(n // 5):
        b.insert(rnd.randrange(len(b) + 1), rnd.choice(letters))
    if rnd.random() < 0.4 and len(b) > 6:
        i = rnd.randrange(len(b) - 3)
        b = b[:i] + b[i + 3 :] + b[i : i + 3]
    return a, b


def test_exact_within_the_budget(spark):
    rnd = random.Random(1)
    keys = {k: pair(rnd, rnd.randrange(0, 30), "abcde", 0.3) for k in range(60)}
    for k, rows in judged(spark, keys).items():
        assert same(rows) == lcs(*keys[k]) and {r["how"] for r in rows} <= {"exact", None}


@pytest.mark.parametrize("cells", [60, 12, 0])
def test_beyond_the_budget(spark, cells):
    """What is called exact is exact: keys whose rows all are have the length of a dynamic programme."""
    rnd = random.Random(cells)
    keys = {k: pair(rnd, rnd.randrange(5, 60), "abcdefgh", 0.7) for k in range(50)}
    hows, got, best = set(), 0, 0
    for k, rows in judged(spark, keys, cells=cells).items():
        own = {r["how"] for r in rows} - {None}
        hows |= own
        n, most = same(rows), lcs(*keys[k])
        assert n == most if own <= {"exact"} else n <= most
        got, best = got + n, best + most
    assert got >= 0.85 * best and ("greedy" in hows or cells > 12) and "exact" in hows and "anchored" in hows


def test_safe_anchors_cost_nothing(spark):
    """Long sequences of unique lines with edits need no choice whatever the budget."""
    a = [f"line {i}" for i in range(3000)]
    b = [x for i, x in enumerate(a) if i % 7] + ["end"]
    for i in range(0, 2500, 50):
        b.insert(i, f"new {i}")
    rows = judged(spark, {1: (a, b)}, cells=100)[1]
    assert same(rows) == sum(x in set(a) for x in b) and {r["how"] for r in rows} <= {"exact", None}


def test_longest_run():
    rnd = random.Random(2)
    for _ in range(300):
        v = rnd.sample(range(40), rnd.randrange(12))
        got = A.increasing(v)
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0) and [v[i] for i in got] == sorted(v[i] for i in got) and got == sorted(got)


def test_tokens_unfit_for_anchors_are_none(spark):
    a, b = [f"l{i}" for i in range(40)], [f"l{i}" for i in range(1, 40)]
    left, right = two(spark, {1: (a, b)})
    rows = A.align(left, right, "k", "o", "t", cells=4, fit=F.col("t") == "l20").collect()
    assert same(rows) == 39 and {r["how"] for r in rows if r["kind"] == "same"} == {"exact", "greedy"}


def test_odd_rows(spark):
    left = spark.createDataFrame([(None, 1, "a"), (None, 2, None), (1, None, "x"), (1, 5, "y"), (2, 1, "only")], "k long, o long, t string").withColumn("gap", F.lit("clash")).withColumn("at", F.lit(0))
    right = spark.createDataFrame([(None, 1, None), (1, 1, "y"), (1, 2, "n"), (3, 1, "other")], "k long, o long, t string").withColumn("side", F.lit("clash"))
    got = {tuple(r)[:5] for r in A.align(left, right, "k", "o", "t").collect()}
    assert got == {(None, "removed", 1, None, "a"), (None, "same", 2, 1, None), (1, "removed", None, None, "x"), (1, "same", 5, 1, "y"), (1, "added", None, 2, "n"), (2, "removed", 1, None, "only"), (3, "added", None, 1, "other")}
    assert A.align(left.limit(0), right.limit(0), "k", "o", "t").count() == 0
