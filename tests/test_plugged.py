"""The pluggable format: byte ranges, pushed filters, offsets, replacing and the cap."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import datasource as D

SCHEMA = "k long, s string, v double, b boolean, a array<long>, missing string"


@pytest.fixture
def written(spark, tmp_path):
    D.register(spark)
    rnd = random.Random(1)
    rows = [(i if i % 9 else None, rnd.choice(["", "é\n\"x\"", "long " * rnd.randrange(40), None]), i / 7, i % 2 == 0, [i, None], "x") for i in range(700)]
    spark.createDataFrame(rows, SCHEMA.replace("missing", "unknown")).repartition(3).write.format("quillon_lines").option("path", f"file:{tmp_path}").mode("append").save()
    return rows, str(tmp_path)


def key(r):
    return str([*r][:5])


@pytest.mark.parametrize("split", [2000, 1 << 20])
def test_every_line_is_read_once(spark, written, split):
    rows, path = written
    got = spark.read.format("quillon_lines").schema(SCHEMA).options(path=path, splitBytes=split).load()
    assert sorted(map(key, got.collect())) == sorted(map(key, rows)) and got.filter("missing IS NOT NULL").count() == 0


def test_ranges_of_any_width(tmp_path):
    for trial in range(200):
        rnd = random.Random(trial)
        lines = [json.dumps({"k": i, "s": "x" * rnd.choice([0, 1, 5, 70])}) for i in range(rnd.randrange(6))]
        end = rnd.choice(["", "\n", "\n\n"])
        (tmp_path / "part-a.json").write_text("\n".join(lines) + end)
        source = D._Lines(None, {"path": str(tmp_path), "splitBytes": rnd.randrange(1, 90)})
        assert [x.decode() for r in source.ranges() for x in source.lines(r) if x] == lines


def test_filters_are_pushed(spark, written):
    rows, path = written
    load = lambda on=True: spark.read.format("quillon_lines").schema(SCHEMA).options(path=path, pushdown=on).load()
    conditions = {"k > 300 AND b": lambda r: (r[0] or 0) > 300 and r[3], "k IS NULL": lambda r: r[0] is None, "s IN ('', 'no') AND v < 50.0": lambda r: r[1] == "" and r[2] < 50, "s LIKE 'long%'": lambda r: (r[1] or "").startswith("long"), "k <=> 5": lambda r: r[0] == 5, "k + 1 = 8 OR v >= 99": lambda r: r[0] == 7 or r[2] >= 99}
    for c, f in conditions.items():
        assert sorted(map(key, load().filter(c).collect())) == sorted(key(r) for r in rows if f(r)), c
    plan = load().filter("k > 300 AND b")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.split("BatchScan")[0]
    df = load(False)  # without pushdown one DataFrame serves any number of queries
    assert df.filter("k > 690").count() < df.filter("k + 1 > 0").count() < df.count() == len(rows)


def test_a_stream_goes_on_where_it_ended(spark, written, tmp_path_factory):
    rows, path = written
    out = tmp_path_factory.mktemp("stream")

    def run():
        s = spark.readStream.format("quillon_lines").schema(SCHEMA).options(path=path, splitBytes=5000).load()
        s.writeStream.format("parquet").option("path", str(out / "t")).option("checkpointLocation", str(out / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(out / "t")).count()

    assert run() == len(rows) == run()
    spark.range(10).select(F.col("id").alias("k")).write.format("quillon_lines").option("path", path).mode("append").save()
    assert run() == len(rows) + 10


def test_limits_and_odd_folders(spark, written, tmp_path_factory):
    rows, path = written
    read = lambda **o: spark.read.format("quillon_lines").schema(SCHEMA).options(**o).load()
    with pytest.raises(Exception, match="at most 10 are read"):
        read(path=path, maxBytes=10).count()
    assert read(path=str(tmp_path_factory.mktemp("none"))).count() == 0 == read(path="/nowhere/at/all").count()
    with pytest.raises(Exception, match="no binary"):
        spark.read.format("quillon_lines").schema("k binary").option("path", path).load().count()
    spark.range(3).write.format("quillon_lines").option("path", path).mode("overwrite").save()
    assert spark.read.format("quillon_lines").schema("id long").option("path", path).load().count() == 3
