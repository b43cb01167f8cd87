"""Ledger queries: orders of a customer are that customer's ledger."""

from pyspark.sql import functions as F

from quillon.operators import ledger as L
from quillon.plans.plugged import folder
from quillon.plans.registry import query
from quillon.sources.tables import load
from quillon.streaming import ledgers as S

_LINE = "'{\"seq\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}'"
_CHAIN = f"c AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, {_LINE} AS line, row_number() OVER w - 1 AS seq, lag(sha256({_LINE})) OVER w AS prev_hash FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


def ledger(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return L.chain(o, "o_custkey", "o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))))


@query("w06_hash_chain", f"WITH {_CHAIN} SELECT o_custkey, seq, line, prev_hash FROM c")
def hash_chain(spark, sf):
    return ledger(spark, sf).select("o_custkey", "seq", "line", "prev_hash")


@query("w06_broken_chain", f"WITH {_CHAIN} SELECT o_custkey, seq, true AS bad_hash, false AS bad_seq FROM c WHERE seq = 2 AND o_custkey % 5 = 0")
def broken_chain(spark, sf):
    """Every fifth customer's third entry was tampered with."""
    bad = (F.col("seq") == 2) & (F.col("o_custkey") % 5 == 0)
    return L.broken(ledger(spark, sf).withColumn("prev_hash", F.when(bad, "00").otherwise(F.col("prev_hash"))), "o_custkey")


@query("w07_double_claims", f"WITH {_CHAIN} SELECT o_custkey || o_orderpriority AS claim, min(seq) AS first_seq, count(*) AS times FROM c WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def double_claims(spark, sf):
    l = ledger(spark, sf).withColumn("claim", F.concat(F.col("o_custkey").cast("string"), F.col("o_orderpriority")))  # noqa: E741
    return L.double_claims(l, "claim", F.col("o_orderstatus") == "F")


@query("d10_receipts", f"WITH {_CHAIN} SELECT o_custkey, seq, sha256(o_orderkey::VARCHAR) AS input_sha, sha256(line) AS output_sha, seq = 0 OR prev_hash IS NOT NULL AS lineage_ok FROM c")
def receipts(spark, sf):
    l = ledger(spark, sf)  # noqa: E741
    return l.select("o_custkey", "seq", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("input_sha"), F.sha2("line", 256).alias("output_sha"), ((F.col("seq") == 0) | F.col("prev_hash").isNotNull()).alias("lineage_ok"))


@query("d11_guard", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def guard(spark, sf):
    c = load(spark, sf, "customer")
    h = F.sha2("c_name", 256)
    return L.guarded(c, F.when(F.col("c_custkey") % 3 == 0, "stale").otherwise(h), h).select("c_custkey")


def streamed(spark, parts, chain, **trigger):
    """What a stream over parts, written one after the other, appends to a table; it is started anew for each, from its offsets."""
    trigger = trigger or {"availableNow": True}
    path, table, check = (folder(spark, n) for n in ("entries", "ledger", "offsets"))
    for part in parts:
        part.write.mode("append").parquet(path)
        chain(spark.readStream.schema(part.schema).parquet(path)).writeStream.format("parquet").option("path", table).option("checkpointLocation", check).trigger(**trigger).start().awaitTermination()
    return spark.read.parquet(table)


@query(
    "w06_ledger_stream",
    """WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(turn, -1) || ':' || coalesce(role, '') || ':' || sha256(coalesce(text, '')) AS line FROM conversations WHERE conv_id IS NOT NULL)
    SELECT conv_id, turn AS "order", row_number() OVER w - 1 AS seq, line, lag(sha256(line)) OVER w AS prev_hash, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, line) = 1 AS first_claim FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, line)""",
)
def ledger_stream(spark, sf):
    """Conversations as ledgers of turns, streamed in two runs from one checkpoint; the first turn of each speaker wins its claim."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    line = F.concat_ws(":", F.coalesce("turn", F.lit(-1)).cast("string"), F.coalesce("role", F.lit("")), "sha")
    early = F.coalesce(F.col("turn") < 2, F.lit(True))
    got = streamed(spark, [c.filter(early), c.filter(~early)], lambda s: S.chained(s, "conv_id", "turn", line, F.coalesce("role", F.lit(""))))
    return got.select("conv_id", "order", "seq", "line", "prev_hash", "first_claim")
