"""Queries over all rows of small tables of their own, against brute force."""

import os
import random
import subprocess
import sys
from pathlib import Path
from statistics import median

import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import joins, order
from quillon.plans.registry import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_alignment_noise_of_all_documents(spark, tmp_path):
    texts = {1: "a\nb\nc", 2: "x\nx\ny", 3: "one", 4: "", 28: "p\nq", 30: "\n".join(f"line {i // 2}" for i in range(2500))}
    got = QUERIES["d04_alignment_noise"](spark, folder(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")).first()
    lines = [t.split("\n") for t in texts.values()]
    by_place = sum(1 + sum(x != y for x, y in zip(ls, ls[1:])) for ls in lines)
    assert (got["by_place"], got["by_alignment"]) == (by_place, len(texts))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(16))] for _ in "xy")
        same = joins.common_pairs(a, b)
        assert same == sorted(same) and len({i for i, _ in same}) == len({j for _, j in same}) == len(same) == lcs(a, b) and all(a[i] == b[j] for i, j in same)
    a = [str(rng.randrange(400)) for _ in range(6000)]
    b = [x for x in a if rng.random() > 0.2] + ["z"] * 900
    assert len(joins.common_pairs(a, b)) == len(b) - 900
    assert joins.common_pairs([], []) == joins.common_pairs(["a"], []) == []


def test_numbers_with_payload_through_a_write(spark, tmp_path):
    n = 1_200_000
    df = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    order.numbered(df, ["key"], "i", 16).write.parquet(str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert tuple(got.agg(F.countDistinct("i"), F.min("i"), F.max("i")).first()) == (n, 0, n - 1)
    w = Window.orderBy("i")
    assert got.filter("i between 500000 and 501000").withColumn("d", F.col("key") > F.lag("key").over(w)).filter("NOT d").count() == 0


def test_numbers_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None,), (5,), (5,), (1,), (None,)], "k long")
    got = sorted((r["i"], r["k"]) for r in order.numbered(rows, ["k"], "i", 3).collect())
    assert got == [(0, None), (1, None), (2, 1), (3, 5), (4, 5)]
    assert order.numbered(rows.limit(0), ["k"], "i").count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_medians(spark, monkeypatch, few):
    """By a window where values are few, by ranges where they aren't."""
    monkeypatch.setattr(order, "FEW", few)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 2.5, float(rng.randrange(50))])) for _ in range(501)] + [(None, 3.0), ("c", None)]
    got = {r["g"]: r["m"] for r in order.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    assert got == {g: median([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", None)}


def test_lines_sink_appends_and_overwrites(spark, tmp_path):
    from quillon.sources import datasource

    datasource.register(spark)
    write = lambda n, mode: spark.range(n).coalesce(2).write.format("quillon_lines").option("path", str(tmp_path)).mode(mode).save()
    write(5, "append")
    write(3, "append")
    assert spark.read.json(str(tmp_path)).count() == 8
    write(2, "overwrite")
    assert spark.read.json(str(tmp_path)).count() == 2


def test_lookup_by_prefix(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, "zz"), (4, None), (5, "")], "i int, k string")
    names = spark.createDataFrame([("a", 1), ("ab", 2), ("abcd", 3), (None, 4)], "n string, v int")
    assert {r["i"]: r["v"] for r in joins.lookup(rows, names, F.col("k"), "n", "v").collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: None}


def test_workers_import_the_package_from_any_folder(tmp_path):
    """Queries with Python workers, in a driver that was started elsewhere and has the package on its own path only."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = __spark_entry__.queries()
for n in ("t17_gated_clauses", "j08_lcs_align", "s10_binary_records", "s18_legacy_strings", "x03_redact_json", "d02_page_diff", "t26_unique_names", "j09_fuzzy_forward"):
    q[n](s, {SF!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in got.stdout, got.stderr[-2000:]


def test_control_gaps_of_a_long_order(spark, tmp_path):
    rows = [(1, i, 0) for i in range(1500)] + [(2, 3, 0), (2, 9, 0), (2, 9, 1), (3, 1, 0)]
    got = QUERIES["p21_control_gaps"](spark, folder(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long"))
    assert {r[0]: r[1] for r in got.collect()} == {1: 1499, 2: 11, 3: 0}


def test_other_queries_stand_where_a_library_lacks(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
sys.modules["ahocorasick"] = None
import __spark_entry__
q = __spark_entry__.queries()
print(len(q) > 200, sorted(n for n in q if n.startswith("op") or n == "pipeline"), len(__spark_entry__.oracle_sql()) > 200)
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.stdout.split("\n")[0] == "True [] True", got.stderr[-2000:]
