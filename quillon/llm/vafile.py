"""Exact top-k inner-product search with vector-approximation files.

Components become integers; a vector's approximation keeps a byte of each (its cell) and one shift. For a
query the cells bound the score from both sides. A scan of the approximations alone leaves the candidates whose
upper bound reaches the k-th best lower bound; then exact vectors are read in the order of upper bounds: a
first few of each query, and after that only those whose bound still reaches the k-th exact score.

Queries and approximations are cut into blocks of bounded size, and each pair of blocks is one group, so
nothing is broadcast and exact vectors move only where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.runtime import discard, materialize, session, table, turn_to

#: Rows in a block of candidates and of queries, the fewest blocks of candidates, and queries of one step.
BLOCK, QUERIES, FEWEST, STEP = 8192, 2048, 64, 256
#: Bits of a component that its cell keeps, its sign included.
CELL_BITS = 8
#: Exact vectors that are read for a query before the rest is judged anew, as a multiple of k.
FIRST = 4


def _matrix(col: pa.Array, kind) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, kind).reshape(len(col), -1) if len(col) else np.zeros((0, 0), kind)


def bounds(qv: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's inner product with each candidate: a component lies between its
    cell's ends, and which end counts depends on the query's sign."""
    exact = float(np.abs(qv).max(initial=1)) * (1 << CELL_BITS) * max(1, cells.shape[1]) < 2**52
    base = (qv.astype(np.float64) @ cells.T.astype(np.float64)).astype(np.int64) if exact else qv @ cells.T.astype(np.int64)
    width = (np.int64(1) << shift.astype(np.int64)) - 1
    base = base << shift.astype(np.int64)
    return base + np.minimum(qv, 0).sum(1)[:, None] * width, base + np.maximum(qv, 0).sum(1)[:, None] * width


def survivors(qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cells: np.ndarray, shift: np.ndarray, k: int):
    """(query, candidate, lower, upper) by place: the candidates of other ids whose upper bound reaches the k-th best lower."""
    out = []
    for at in range(0, len(qid), STEP):
        low, up = bounds(qv[at : at + STEP], cells, shift)
        for i in range(len(low)):
            other = np.flatnonzero(cid != qid[at + i])
            if not len(other):
                continue
            m = min(k, len(other))
            lo, hi = low[i][other], up[i][other]
            left = np.flatnonzero(hi >= np.partition(lo, len(lo) - m)[len(lo) - m])
            out.append((np.full(len(left), at + i), other[left], lo[left], hi[left]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _group(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        turn_to("vafile")
        if not q.num_rows or not c.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"qid": none, "query_id": none, "rid": none, "vec_id": none, "low": none, "up": none})
        qid, cid = q["id"].to_numpy(), c["id"].to_numpy()
        i, j, low, up = survivors(qid, _matrix(q["v"], np.int64), cid, _matrix(c["cells"], np.int8), c["shift"].to_numpy(), k)
        return pa.table({"qid": q["qid"].to_numpy()[i], "query_id": qid[i], "rid": c["rid"].to_numpy()[j], "vec_id": cid[j], "low": low, "up": up})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k rows of
    other ids with the highest inner product of floor(1024 * x), ties to smaller ids.

    Vectors that are null, or hold null or non-finite components, and null ids take no part.
    Vectors are compared with those of their own length, however long; empty ones take no part. Each row is a
    candidate, so a repeated one takes several ranks; rows alike in id and vector are one query, and
    vectors that share an id are queries of their own. An empty table gives no rows; other columns are ignored.
    """
    session(vectors.sparkSession)
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(ok)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "id", F.transform("v", lambda e: F.floor(e * 1024)).alias("v"))
    most = F.array_max(F.transform("v", lambda e: F.abs(e)))
    rows = materialize(rows.withColumn("shift", F.greatest(F.lit(0), F.length(F.bin(most)) - (CELL_BITS - 1))), "va-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    blocks, qblocks = max(FEWEST, -(-sizes["n"] // BLOCK)), max(1, -(-sizes["q"] // QUERIES))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id", "v").agg(F.min("rid").alias("qid"))
    # copies of a vector go to different blocks, as blocks are dealt by row
    cells = rows.select("rid", "id", "shift", F.size("v").alias("d"), F.expr("transform(v, e -> CAST(shiftright(e, shift) AS TINYINT))").alias("cells"))
    cand = cells.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    quer = queries.select("qid", "id", "v", F.size("v").alias("d")).withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qblocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = quer.groupBy("d", "qb", "b").cogroup(cand.groupBy("d", "qb", "b")).applyInArrow(_group(k), "qid long, query_id long, rid long, vec_id long, low long, up long")
    best = Window.partitionBy("qid").orderBy(F.desc("low"), "rid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumn("sure", F.nth_value("low", k).over(best)).filter(F.col("sure").isNull() | (F.col("up") >= F.col("sure")))
    near = materialize(near.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("up"), "rid"))).drop("low", "sure"), "va-near")

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores from the vectors themselves."""
        with_c = pairs.join(rows.select("rid", F.col("v").alias("cv")), "rid")
        with_q = with_c.join(queries.select("qid", F.col("v").alias("qv")), "qid")
        return with_q.select("qid", "query_id", "rid", "vec_id", F.aggregate(F.zip_with("cv", "qv", lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x).alias("score"))

    first = materialize(exact(near.filter(F.col("pos") <= FIRST * k)), "va-first")
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid"))).filter(F.col("r") == k).select("qid", F.col("score").alias("kth"))
    rest = near.filter(F.col("pos") > FIRST * k).join(kth, "qid").filter(F.col("up") >= F.col("kth")).drop("kth")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid"))
    out = materialize(first.unionByName(exact(rest)).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "va-best")
    discard(rows, near, first)
    return out


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all embeddings for each whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
