"""Diff, verification and gate queries. The second version of a table is derived from the first by id."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from quillon.shipping import discard_later, shared_dir
from quillon.sources import sinks
from quillon.operators import diff as D
from quillon.plans.joins import RUN_A, RUN_B, runs
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, paragraphs

_AFTER = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT -c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0)"


def versions(spark, sf):
    a = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    b = a.filter(k % 13 != 0).select("c_custkey", "c_name", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 11 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return a, b.union(a.filter(k % 50 == 0).withColumn("c_custkey", -k))


_DIFF = f"""x AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey IS NULL THEN 'extra' ELSE 'changed' END AS diff_kind,
    CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN [] ELSE list_filter([CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' END, CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' END], lambda f: f IS NOT NULL) END AS fields
    FROM customer a FULL JOIN {_AFTER} b ON a.c_custkey = b.c_custkey)"""


@query("d01_structural_diff", f"WITH {_DIFF} SELECT diff_kind, count(*) AS n FROM x WHERE diff_kind <> 'changed' OR len(fields) > 0 GROUP BY 1")
def structural_diff(spark, sf):
    return D.field_diff(*versions(spark, sf), ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"]).groupBy("diff_kind").agg(F.count("*").alias("n"))


@query("d02_page_diff")
def page_diff(spark, sf):
    """No SQL: unified diffs as text."""

    @F.pandas_udf("string")
    def unified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([D.unified(x, y) for x, y in zip(a, b, strict=True)])

    d = load(spark, sf, "conversations").withColumn("after", F.replace("text", F.lit(" de "), F.lit(" du ")))
    return d.filter("text <> after").select("conv_id", "turn", unified("text", "after").alias("diff"))


@query("d03_inventory_diff", f"WITH {_DIFF} SELECT * FROM x WHERE diff_kind <> 'changed' OR len(fields) > 0")
def inventory_diff(spark, sf):
    return D.field_diff(*versions(spark, sf), ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])


@query("d05_verify", f"SELECT false AS identical, count(*) AS diff_count FROM (SELECT * FROM (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer EXCEPT ALL SELECT * FROM {_AFTER}) UNION ALL SELECT * FROM (SELECT * FROM {_AFTER} EXCEPT ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer))")
def verify(spark, sf):
    return D.identical(*versions(spark, sf))


@query("d05_verify_written", "SELECT true AS identical, CAST(0 AS BIGINT) AS diff_count, NULL::VARCHAR AS error")
def verify_written(spark, sf):
    """What was written is read again and compared with what was meant."""
    return sinks.verified(load(spark, sf, "customer"), discard_later(spark, f"{shared_dir(spark)}/quillon-verify-{uuid.uuid4().hex}"))


@query("j10_compare_strategies", f"WITH {_DIFF} SELECT 'identity' AS strategy, diff_kind, count(*) AS n FROM x WHERE diff_kind <> 'changed' OR len(fields) > 0 GROUP BY ALL")
def compare_strategies(spark, sf):
    """By stable id; j10_alignment is the other strategy."""
    d = D.compare(*versions(spark, sf), "identity", ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])
    return d.groupBy("diff_kind").agg(F.count("*").alias("n")).select(F.lit("identity").alias("strategy"), "diff_kind", "n")


@query(
    "d02_page_changes",
    f"""WITH {PARAS_SQL}, b AS (SELECT doc_id, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS i, o % 2 = 0 AS new FROM (SELECT doc_id, 2 * para + 1 AS o FROM paras WHERE para % 7 <> 3 UNION ALL SELECT doc_id, 2 * para FROM paras WHERE para % 11 = 5)),
    x AS (SELECT doc_id, page, 1 AS r, 0 AS a FROM paras WHERE para % 7 = 3 UNION ALL SELECT doc_id, CAST(i // 20 AS INTEGER), 0, 1 FROM b WHERE new),
    m AS (SELECT doc_id, ceil(count(*) / 20) AS m FROM paras GROUP BY 1), n AS (SELECT doc_id, ceil(count(*) / 20) AS n FROM b GROUP BY 1)
    SELECT doc_id, page, CASE WHEN page >= coalesce(any_value(n), 0) THEN 'removed' WHEN page >= any_value(m) THEN 'added' ELSE 'changed' END AS kind, CAST(sum(r) AS BIGINT) AS removed, CAST(sum(a) AS BIGINT) AS added FROM x JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY doc_id, page""",
)
def page_changes(spark, sf):
    """Page by page, documents against versions with lines lost and new; lines carry their number, so none is like another."""
    p = paragraphs(load(spark, sf, "documents")).select("doc_id", F.col("para").cast("long").alias("para"), F.sha2(F.concat("text", F.lit(":"), F.col("para").cast("string")), 256).alias("text"))
    new = p.filter("para % 11 = 5").select("doc_id", (2 * F.col("para")).alias("para"), F.concat(F.lit("new "), F.col("para").cast("string")).alias("text"))
    after = p.filter("para % 7 <> 3").select("doc_id", (2 * F.col("para") + 1).alias("para"), "text").union(new)
    return D.page_changes(p, after, "doc_id", "para", "text")


@query(
    "j10_alignment",
    f"""WITH {PARAS_SQL} SELECT doc_id, 'alignment' AS strategy, count(*) FILTER (para % 7 = 3) AS missing, count(*) FILTER (para % 11 = 5) AS extra FROM paras GROUP BY doc_id HAVING missing + extra > 0""",
)
def compare_by_alignment(spark, sf):
    """Documents against versions that lost every seventh line and got a new one before every eleventh: nothing else differs."""
    p = paragraphs(load(spark, sf, "documents")).select("doc_id", F.col("para").cast("long").alias("para"), F.sha2("text", 256).alias("text"))
    new = p.filter("para % 11 = 5").select("doc_id", (2 * F.col("para")).alias("para"), F.concat(F.lit("new "), F.col("para").cast("string")).alias("text"))
    after = p.filter("para % 7 <> 3").select("doc_id", (2 * F.col("para") + 1).alias("para"), "text").union(new)
    got = D.compare(p, after, "alignment", ["doc_id"], ["text"], "para")
    return got.groupBy("doc_id").agg(F.lit("alignment").alias("strategy"), F.count_if(F.col("diff_kind") == "missing").alias("missing"), F.count_if(F.col("diff_kind") == "extra").alias("extra"))


_TRANS = f"SELECT doc_id, CASE WHEN a.verdict IS NULL OR b.verdict IS NULL THEN 'MISSING' WHEN a.verdict = 'FAIL' AND b.verdict = 'PASS' THEN 'IMPROVED' WHEN a.verdict = 'PASS' AND b.verdict = 'FAIL' THEN 'REGRESSED' WHEN b.verdict = 'PASS' THEN 'STILL_OK' ELSE 'STILL_BAD' END AS transition FROM {RUN_A} a FULL JOIN {RUN_B} b USING (doc_id)"


def transitions(spark, sf):
    a, b = runs(spark, sf)
    j = a.withColumnRenamed("verdict", "x").join(b.withColumnRenamed("verdict", "y"), "doc_id", "full_outer")
    return j.select("doc_id", D.transition(F.col("x"), F.col("y")).alias("transition"))


@query("d08_transitions", _TRANS)
def transition_rows(spark, sf):
    return transitions(spark, sf)


ORDER = ("REGRESSED", "IMPROVED", "STILL_BAD", "STILL_OK", "ERR_BEFORE", "ERR_AFTER", "ERR_BOTH", "MISSING")


@query("a05_transition_counts", f"SELECT transition, CAST(list_position({list(ORDER)}, transition) AS INTEGER) AS place, count(*) AS n FROM ({_TRANS}) GROUP BY ALL")
def transition_counts(spark, sf):
    """Counts in a fixed order for display."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("transition")).cast("int")
    return transitions(spark, sf).groupBy("transition").agg(F.count("*").alias("n")).select("transition", place.alias("place"), "n")


@query("d06_regression_gate", f"SELECT coalesce(bool_or(transition = 'REGRESSED'), false) AS failed, count(*) FILTER (transition = 'REGRESSED') AS regressed FROM ({_TRANS})")
def regression_gate(spark, sf):
    r = F.col("transition") == "REGRESSED"
    return transitions(spark, sf).agg(F.coalesce(F.bool_or(r), F.lit(False)).alias("failed"), F.count_if(r).alias("regressed"))


@query("d07_snapshot_gate", f"SELECT transition IN ('REGRESSED', 'IMPROVED') AS fails, count(*) AS n FROM ({_TRANS}) GROUP BY 1")
def snapshot_gate(spark, sf):
    """Better fails too, until the snapshot is updated."""
    return transitions(spark, sf).groupBy(F.col("transition").isin("REGRESSED", "IMPROVED").alias("fails")).agg(F.count("*").alias("n"))


@query(
    "d09_field_sweep",
    f"""WITH j AS (SELECT a.c_custkey, unnest([{{'p': 'c_acctbal', 'd': a.c_acctbal <> b.c_acctbal}}, {{'p': 'c_mktsegment', 'd': a.c_mktsegment <> b.c_mktsegment}}]) AS f FROM customer a JOIN {_AFTER} b ON a.c_custkey = b.c_custkey)
    SELECT f.p AS path, count(*) AS n, (list(c_custkey ORDER BY c_custkey))[:3] AS examples FROM j WHERE f.d GROUP BY 1""",
)
def field_sweep(spark, sf):
    return D.sweep(*versions(spark, sf), ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])


@query("d12_failure_isolation", "SELECT doc_id, CASE WHEN doc_id % 19 <> 0 THEN length(text)::BIGINT END AS n, CASE WHEN doc_id % 19 = 0 THEN 'ValueError: bad document' END AS error FROM documents")
def failure_isolation(spark, sf):
    """A bad document gives an error record; the others go on."""
    from quillon.sources.batch import isolated

    def record(row):
        if row["doc_id"] % 19 == 0:
            raise ValueError("bad document")
        return {"doc_id": row["doc_id"], "n": len(row["text"])}

    return isolated(load(spark, sf, "documents").select("doc_id", "text"), record, "doc_id long, n long", keep=["doc_id"])
