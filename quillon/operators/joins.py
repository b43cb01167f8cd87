"""Joins with declared sizes: keyed comparisons of runs, range joins by bucket, as-of joins, alignment."""

from __future__ import annotations

import difflib
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import ship

#: Rows below which a side may be broadcast; larger sides are shuffled.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted up to that bound), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def compare_runs(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join of two runs; what one side lacks is MISSING."""
    a, b = before.select(*on, F.col(value).alias("before")), after.select(*on, F.col(value).alias("after"))
    return a.join(b, on, "full_outer").select(*on, F.coalesce("before", F.lit("MISSING")).alias("before"), F.coalesce("after", F.lit("MISSING")).alias("after"))


def contained(points: DataFrame, spans: DataFrame, on: list[str], point: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """Range join: spans [lo, hi] that hold the point, by buckets of width, so it is an equi-join."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    cond = F.col(point).between(F.col(lo), F.col(hi))
    return p.join(s, [*on, "_b"], how).filter(cond).drop("_b") if how == "inner" else p.alias("p").join(s.alias("s"), [*[F.col(f"p.{c}") == F.col(f"s.{c}") for c in (*on, "_b")], cond], how).drop(F.col("s._b"), F.col("p._b"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """The latest right row at or before each left row: one union, one sort, no join blow-up."""
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    rest = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_s"), F.struct(*rest).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))  # noqa: E741
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_s"), null(l, "_l").alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_s = 1")
    return both.select(*by, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_r.{c}").alias(c) for c in values])


def _sequences(left: DataFrame, right: DataFrame, by: str, order: str, token: str, how: str) -> DataFrame:
    """(by, lo, lt, ro, rt): both sides' orders and tokens in order, as arrays; one row for each key."""

    def side(df: DataFrame, a: str, b: str) -> DataFrame:
        got = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(token).alias("t")))).alias("s"))
        return got.select(by, F.transform("s", lambda x: x["o"]).alias(a), F.transform("s", lambda x: x["t"]).alias(b))

    return side(left, "lo", "lt").join(side(right, "ro", "rt"), by, how)


def _lengths(a: list, b: list) -> list[int]:
    """LCS length of a and each prefix of b. One integer has a bit for each place of b; a step of the whole
    row is a few operations on it."""
    places: dict = {}
    for j, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & full
    # a bit that is 0 is a place where the length grows
    return [0, *accumulate(c == "0" for c in reversed(f"{v:0{len(b)}b}"))] if b else [0]


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Divide and conquer: the first half of a is matched with the part
    of b that gives the longest sum (ties: the shortest part), so memory is linear at any length."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i == 1:
            at = next((k for k in range(j, n) if b[k] == a[i]), None)
            out += [] if at is None else [(i, at)]
            continue
        mid = (i + m) // 2
        head, tail = _lengths(a[i:mid], b[j:n]), _lengths(a[mid:m][::-1], b[j:n][::-1])
        sums = [x + y for x, y in zip(head, reversed(tail), strict=True)]
        cut = j + sums.index(max(sums))
        todo += [(i, mid, j, cut), (mid, m, cut, n)]
    return sorted(out)


def fuzzy_forward(left: DataFrame, right: DataFrame, by: str, order: str, text: str, window: int = 6, ratio: float = 0.7) -> DataFrame:
    """For each left line in order, the first of the next window right lines that is alike enough; greedy."""
    import pandas as pd

    ship(left.sparkSession)
    kind = left.schema[by].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for key, lo, lt, ro, rt in pdf.itertuples(index=False):
                at = 0
                for o, t in zip(lo, lt, strict=True):
                    for j in range(at, min(at + window, len(rt))):
                        if difflib.SequenceMatcher(None, t, rt[j]).ratio() > ratio:
                            out.append((key, o, ro[j]))
                            at = j + 1
                            break
            yield pd.DataFrame(out, columns=[by, "l_order", "r_order"])

    return _sequences(left, right, by, order, text, "inner").select(by, "lo", "lt", "ro", "rt").mapInPandas(run, f"{by} {kind}, l_order long, r_order long")


def lookup(rows: DataFrame, table: DataFrame, key: Column, name: str, value: str) -> DataFrame:
    """Exact name first, else the smallest name that the key starts with. A key's beginnings of the lengths that
    names have are joined by equality, whatever the size of the table."""
    t = table.select(F.col(name).alias("_n"), F.col(value).alias("_v"))
    sizes = sorted(r[0] for r in t.select(F.length("_n")).distinct().collect() if r[0] is not None)
    starts = F.array_distinct(F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("_k")), lambda n: F.substring(F.col("_k"), F.lit(1), n)))
    hit = rows.withColumn("_k", key).withColumn("_s", F.explode_outer(starts)).join(small(t), F.col("_s") == F.col("_n"), "left")
    best = F.min_by("_v", F.when(F.col("_n").isNotNull(), F.struct((F.col("_n") != F.col("_k")).alias("prefix"), "_n")))
    return hit.groupBy(*rows.columns).agg(best.alias(value))
