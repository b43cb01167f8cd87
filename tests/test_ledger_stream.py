"""Chains over streams: equal to the batch windows over orders, over restarts; late entries and seals are reported."""

from conftest import SF
from pyspark.sql import functions as F

from quillon.operators import ledger as L
from quillon.plans.ledgers import streamed
from quillon.streaming import ledgers as S


def test_equals_the_batch_window_over_restarts(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    cut = o.agg(F.expr("percentile(o_orderkey, 0.4)")).first()[0]
    parts = [o.filter(F.col("o_orderkey") <= cut), o.filter(F.col("o_orderkey") > cut)]
    got = streamed(spark, parts, lambda s: S.chained(s, "o_custkey", "o_orderkey", line, F.col("o_orderpriority")))
    want = L.chain(o, "o_custkey", "o_orderkey", line)
    cols = ["o_custkey", "seq", "line", "prev_hash"]
    rows = lambda d: sorted(map(tuple, d.select(cols).collect()), key=str)
    assert rows(got) == rows(want) and got.filter("status <> 'chained'").count() == 0
    firsts = sorted(map(tuple, got.filter("first_claim").select("o_custkey", "order").collect()))
    assert firsts == sorted(map(tuple, o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k")).select("o_custkey", "k").collect()))


def test_late_entries_seals_and_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, o long, l string, c string").withColumn("key", F.lit("clash")).withColumn("order", F.lit(0)).withColumn("seq", F.lit(0))
    parts = [make([("a", 5, "x", "p"), ("a", 2, "w", None), ("b", None, None, "q"), (None, 1, "n", "q")]), make([("a", 3, "late", "r"), ("a", 5, "y", "p"), ("a", 6, "z", "r")]), make([("c", 1, "", None)])]
    got = streamed(spark, parts, lambda s: S.chained(s, "k", "o", F.col("l"), F.col("c"), idle_ms=1), once=True)  # timers fire in the batch after
    rows = {(r["k"], r["order"], r["status"], r["seq"], r["line"], r["first_claim"]) for r in got.collect()}
    assert {r for r in rows if r[2] != "sealed"} == {("a", 2, "chained", 0, "w", None), ("a", 5, "chained", 1, "x", True), ("b", -1, "chained", 0, "", True), ("a", 3, "late", None, "late", None), ("a", 5, "chained", 2, "y", False), ("a", 6, "chained", 3, "z", True), ("c", 1, "chained", 0, "", None)}
    assert ("b", -1, "sealed", 1, None, None) in rows and got.filter("status = 'sealed' AND prev_hash IS NULL").count() == 0


def test_a_key_looks_at_its_state_once_for_the_head_and_once_for_each_earlier_claim():
    from pyspark.sql import Row

    calls = []

    class State:
        def __init__(self, name, value=None):
            self.name, self.value = name, value

        def __getattr__(self, name):
            def call(*args):
                calls.append(f"{self.name}.{name}")
                return self.value if name == "get" else self.value is not None

            return call

    def run(head, rows):
        calls.clear()
        c = S.Chain()
        c.head, c.claims = State("head", head), State("claims")
        return list(c.handleInputRows((1,), iter(Row(order=o, line=line, claim=k) for o, line, k in rows), None))

    got = run(None, [(2, "b", "p"), (1, "a", "p"), (3, "c", None)])
    assert [(r.order, r.seq, r.first_claim) for r in got] == [(1, 0, True), (2, 1, False), (3, 2, None)]
    assert calls == ["head.get", "claims.updateValue", "head.update"]
    got = run((3, 3, "00"), [(2, "late", "p"), (4, "d", "q"), (5, "e", "q")])
    assert [(r.status, r.seq, r.first_claim) for r in got] == [("late", None, None), ("chained", 3, True), ("chained", 4, False)]
    assert calls == ["head.get", "claims.containsKey", "claims.updateValue", "head.update"]
