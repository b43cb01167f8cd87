"""What goes wrong only beyond some size: coalesced unions, probes that end within a character, long listings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators.alignment import align
from quillon.sources import encoding, files


def test_alignment_of_sides_that_come_shuffled(spark):
    """Sides that windows by the key have shuffled, and that adaptive execution would coalesce apart, meet all the same."""
    at = "spark.sql.adaptive"
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", f"{at}.advisoryPartitionSizeInBytes", f"{at}.coalescePartitions.minPartitionSize", f"{at}.coalescePartitions.parallelismFirst")}
    for k, v in zip(old, ("16", "50000b", "1b", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        place = F.row_number().over(Window.partitionBy("k").orderBy("n")) - 1
        rows = spark.range(6000).select((F.col("id") % 500).alias("k"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        left, right = rows.select("k", place.alias("o"), "t"), rows.filter("n % 4 = 0").select("k", place.alias("o"), "t")
        got = {r["kind"]: r["count"] for r in align(left, right, "k", "o", "t").groupBy("kind").count().collect()}
        assert got == {"same": 1500, "removed": 4500}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_probe_that_ends_within_a_character(spark):
    for mark in ("é", "€", "\U0001f600"):
        for shift in range(4):
            raw = ("<HWPML>" + "a" * shift + mark * encoding.PROBE).encode()
            df = spark.createDataFrame([(bytearray(raw),)], "c binary")
            assert df.select(encoding.file_format(F.col("c"))).first()[0] == "hml"


def test_listing_beyond_five_digits(spark):
    names = spark.range(100_002).select(F.format_string("r/%07d", "id").alias("path"))
    got = files.listing(names, "r").filter("rel IN ('0000007', '0099999', '0100000', '0100001')")
    assert {(r["docid"], r["rel"]) for r in got.collect()} == {("00007", "0000007"), ("99999", "0099999"), ("100000", "0100000"), ("100001", "0100001")}


def test_estimate_keeps_one_sketch_a_group(spark):
    """No sketch is kept for each value: the plan has no aggregate that groups by the part and estimates."""
    from conftest import SF

    from quillon.plans.registry import QUERIES

    plan = QUERIES["rel_distinct_estimate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(keys=[l_returnflag" in line and "l_partkey" in line.split("functions=")[0]]
    assert keyed and not any("approx_count_distinct" in line for line in keyed)


def test_whole_texts_come_in_small_batches(spark):
    """Clauses and containers take few texts at a time, however many rows a task has."""
    from quillon.operators import structure
    from quillon.sources import containers

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    for made in (lambda: structure.clauses(docs), lambda: containers.packed(docs, "doc_id", "text", "true"), lambda: containers.entries(docs.select("doc_id", F.encode("text", "UTF-8").alias("b")), "doc_id", "b")):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        made()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_trees_are_read_without_joins(spark):
    """Ancestors come from paths: nothing is joined with the nodes, and a page is parsed once."""
    from conftest import SF

    from quillon.plans.registry import QUERIES

    for name in ("t01_nested_cells", "t19_nested_grid", "k16_nested_html"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1, name  # the join puts lines to orders
