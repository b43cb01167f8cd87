"""Near duplicates among vectors by an epsilon grid order join.

Vectors of unit length are turned onto the leading principal dimensions (fitted on a bounded sample; a turn changes no
distance) and sorted by the cells of a grid whose side is the largest distance of a link. The order is cut into blocks. A
block keeps the bounds of its vectors in those dimensions and of what is left of them beyond; two blocks whose bounds are
further apart than a link are provably distant. Intervals of the order are joined recursively: pairs of long intervals are
replaced by the pairs of their parts, as DataFrames, until blocks are left, and a task goes on within two blocks down to
LEAF vectors, whose inner products are one matrix product.

Exact copies are one vector with a weight. A task returns a link count for each vector and a spanning tree of the links it
found, so near copies, however many, give no more rows than vectors and blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.runtime import discard, materialize, session, table, turn_to

#: Vectors of one length that the principal dimensions are fitted on, and the dimensions that are used.
SAMPLE, DIMS = 2048, 8
#: Vectors of a block and of a leaf; parts of an interval.
BLOCK, LEAF, PARTS = 1024, 64, 8
#: Allowance for rounding when bounds are compared; what is linked is decided by cosines alone.
SLACK = 1e-6
#: Cosines as float sums differ in their last bits with the order of summation; within so much of the threshold they are summed exactly.
CLOSE = 1e-12


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very small or large components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors its leading principal dimensions, by columns, from at most SAMPLE vectors."""
    by = Window.partitionBy("d").orderBy("h1", "h2", "label")
    # of many vectors only those below a hash come to the window: four times as many as asked for
    share = vectors.groupBy("d").agg(F.least(F.lit(1.0), 4.0 * SAMPLE / F.count("*")).alias("share"))
    low = vectors.join(share, "d").filter(F.col("h1") / 2.0**64 + 0.5 < F.col("share"))
    chosen = low.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= SAMPLE).select("d", "v")

    def fit(t: pa.Table) -> pa.Table:
        x = unit(_matrix(t["v"]))
        _, _, turn = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        return pa.table({"d": t["d"][:1], "axes": pa.array([turn[:DIMS].ravel().tolist()], pa.list_(pa.float64()))})

    got = chosen.groupBy("d").applyInArrow(fit, "d int, axes array<double>").collect()  # DIMS vectors for each length
    return {r["d"]: np.array(r["axes"]).reshape(-1, r["d"]).T for r in got}


def _turned(turns_b, side: float):
    """Adds p: coordinates in the leading dimensions and the length of the rest; c: their cells."""

    def run(batches):
        turn_to("egojoin")
        for b in batches:
            p, c = [None] * b.num_rows, [None] * b.num_rows
            d = b.column(b.schema.get_field_index("d")).to_numpy()
            for n in np.unique(d):
                at = np.flatnonzero(d == n)
                x = unit(_matrix(b.column(b.schema.get_field_index("v")).take(pa.array(at))))
                lead = x @ turns_b.value[int(n)]
                rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
                place = np.column_stack([lead, np.zeros((len(at), DIMS - lead.shape[1])), rest])
                for i, row, cell in zip(at, place.tolist(), np.floor(place / side).astype(np.int32).tolist(), strict=True):
                    p[i], c[i] = row, cell
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64())), pa.array(c, pa.list_(pa.int32()))], [*b.schema.names, "p", "c"])

    return run


def _close(low1: Column, high1: Column, low2: Column, high2: Column, side: float) -> Column:
    """Whether two boxes may hold vectors within side of each other."""
    gap = F.zip_with(F.zip_with(low1, high2, lambda a, b: a - b), F.zip_with(low2, high1, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda t, g: t + g * g) <= side * side + SLACK


def _bounds(df: DataFrame, *by: str) -> DataFrame:
    low = [F.min(F.col("low")[i]) for i in range(DIMS + 1)]
    return df.groupBy(*by).agg(F.array(*low).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(DIMS + 1)]).alias("high"))


def block_pairs(blocks: DataFrame, side: float) -> DataFrame:
    """(label, d, i, j), i <= j, of blocks (label, d, o, low, high) that aren't provably distant; o counts from 0."""
    top = blocks.agg(F.max("o")).first()[0] or 0
    levels = 0
    while PARTS**levels <= top:
        levels += 1
    pairs = blocks.select("label", "d").distinct().select("label", "d", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for level in range(levels - 1, -1, -1):
        boxes = materialize(_bounds(blocks.withColumn("o", F.floor(F.col("o") / PARTS**level).cast("int")), "label", "d", "o"), "ego-boxes")
        parts = lambda c: F.explode(F.sequence(F.col(c) * PARTS, F.col(c) * PARTS + (PARTS - 1)))
        down = pairs.select("label", "d", parts("i").alias("i"), "j").select("label", "d", "i", parts("j").alias("j")).filter("i <= j")
        of = lambda c: boxes.select("label", "d", F.col("o").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
        near = down.join(of("i"), ["label", "d", "i"]).join(of("j"), ["label", "d", "j"])
        pairs = materialize(near.filter(_close(F.col("low_i"), F.col("high_i"), F.col("low_j"), F.col("high_j"), side)).select("label", "d", "i", "j"), "ego-pairs")
    return pairs


def _leaves(p: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary tree over intervals of rows, as (from, to, low, high), node k's parts at 2k + 1 and 2k + 2."""
    out: list = []
    todo = [(0, 0, len(p))]
    while todo:
        k, lo, hi = todo.pop()
        out += [None] * (k + 1 - len(out))
        out[k] = (lo, hi, p[lo:hi].min(axis=0), p[lo:hi].max(axis=0))
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            todo += [(2 * k + 1, lo, mid), (2 * k + 2, mid, hi)]
    return out


def near_intervals(p: np.ndarray, q: np.ndarray | None, side: float):
    """Pairs of leaf intervals that aren't provably distant, of two sequences, or of one with itself (q None: each pair once)."""
    a = _leaves(p)
    b = a if q is None else _leaves(q)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        (lo1, hi1, low1, high1), (lo2, hi2, low2, high2) = a[i], b[j]
        gap = np.maximum(0, np.maximum(low1 - high2, low2 - high1))
        if float(gap @ gap) > side * side + SLACK:
            continue
        split1, split2 = hi1 - lo1 > LEAF, hi2 - lo2 > LEAF
        if not split1 and not split2:
            yield lo1, hi1, lo2, hi2
        else:
            left = (2 * i + 1, 2 * i + 2) if split1 else (i,)
            right = (2 * j + 1, 2 * j + 2) if split2 else (j,)
            todo += [(x, y) for x in left for y in right if q is not None or x <= y or i != j]


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least least."""
    cos = x @ y.T
    out = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < CLOSE), strict=True):  # as if added up in the order of components
        out[i, j] = float(np.cumsum(x[i] * y[j])[-1]) >= least
    return out


def join_blocks(x: np.ndarray, p: np.ndarray, wx: np.ndarray, y: np.ndarray | None, q: np.ndarray | None, wy: np.ndarray | None, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weights of the links of each row of x, and of y after them, and links that span what is connected. y None: x with itself."""
    n = len(x)
    alone = y is None
    y, w2, shift = (x, wx, 0) if alone else (y, wy, n)
    total = np.zeros(n if alone else n + len(y), np.int64)
    part = np.arange(len(total))
    tree: list[tuple[int, int]] = []
    for lo1, hi1, lo2, hi2 in near_intervals(p, None if alone else q, float(np.sqrt(2 - 2 * least))):
        hit = linked(x[lo1:hi1], y[lo2:hi2], least)
        if alone and lo1 == lo2:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        total[lo1:hi1] += hit @ w2[lo2:hi2]
        if not (alone and lo1 == lo2):
            total[shift + lo2 : shift + hi2] += wx[lo1:hi1] @ hit
        one, other = part[lo1:hi1], part[shift + lo2 : shift + hi2]
        joins = hit & (one[:, None] != other)
        while joins.any():  # once for each part that is joined to another
            i, j = divmod(int(joins.argmax()), joins.shape[1])
            tree.append((lo1 + i, shift + lo2 + j))
            part[part == other[j]] = one[i]
            joins &= one[:, None] != other
    return total, tree


def _join(least: float):
    def run(batches):
        turn_to("egojoin")
        for b in batches:
            for k in range(b.num_rows):
                one = {n: b.column(i).slice(k, 1) for i, n in enumerate(b.schema.names)}
                ids = [one[f"id{s}"].flatten().to_numpy() for s in "12"]
                w = [one[f"w{s}"].flatten().to_numpy() for s in "12"]
                x = [unit(_matrix(one[f"v{s}"].flatten())) for s in "12" if len(ids["12".index(s)])]
                p = [_matrix(one[f"p{s}"].flatten()) for s in "12" if len(ids["12".index(s)])]
                total, tree = join_blocks(x[0], p[0], w[0], *((x[1], p[1], w[1]) if len(x) > 1 else (None,) * 3), least)
                every = np.concatenate(ids)
                at = np.flatnonzero(total)
                a, c = np.array(tree, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([every[at], every[a]])), pa.array(np.concatenate([total[at], np.zeros(len(a), np.int64)])), pa.array([None] * len(at) + every[c].tolist(), pa.int64())], ["id", "links", "other"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: rows of its label with a cosine of at least least, the smallest id
    reachable by such links, and whether that is its own.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing and
    are kept, as are vectors of different lengths. Repeated rows are vectors of their own that link with each other; a null
    id is larger than all others. An empty table gives no rows; other columns are ignored.
    """
    spark = session(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    h = [F.when(F.coalesce(fit, F.lit(False)), F.xxhash64(F.lit(k), "v")) for k in (1, 2)]
    told = rows.withColumns({"h1": h[0], "h2": h[1], "d": F.size("v")})
    key = ["label", "d", "h1", "h2"]
    groups = told.filter("h1 IS NOT NULL").groupBy(*key).agg(F.count("*").alias("w"), F.min("vec_id").alias("low_id"), F.first("v").alias("v"))
    classes = materialize(groups, "ego-classes")
    side = float(np.sqrt(2 - 2 * least))
    turns = spark.sparkContext.broadcast(axes(classes.select("label", "d", "h1", "h2", "v")))
    kinds = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    placed = classes.mapInArrow(_turned(turns, side), f"{kinds}, p array<double>, c array<int>")
    # ties of cells are dealt by place and hash, so that one crowded cell is several partitions
    order = ["label", "d", "c", "p", "h1"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("b", F.shiftright("id", BLOCK.bit_length() - 1)), "ego-order")
    boxes = _bounds(ordered.select("label", "d", "b", F.col("p").alias("low"), F.col("p").alias("high")), "label", "d", "b")
    # a row for each block; their order is that of the sequence
    blocks = materialize(boxes.withColumn("o", F.row_number().over(Window.partitionBy("label", "d").orderBy("b")) - 1), "ego-blocks")
    pairs = block_pairs(blocks, side)
    packed = ordered.groupBy("label", "d", "b").agg(F.sort_array(F.collect_list(F.struct("id", "w", "v", "p"))).alias("m"))
    packed = materialize(packed.join(blocks.select("label", "d", "b", "o"), ["label", "d", "b"]).select("label", "d", "o", *[F.col(f"m.{c}").alias(c) for c in ("id", "w", "v", "p")]), "ego-packed")
    side_of = lambda s, at: packed.select("label", "d", F.col("o").alias(at), *[F.col(c).alias(f"{c}{s}") for c in ("id", "w", "v", "p")])
    # a block with itself has an empty second side
    second = pairs.withColumn("spread", F.xxhash64("i", "j")).join(side_of(1, "i"), ["label", "d", "i"])
    apart = second.filter("i <> j").join(side_of(2, "j"), ["label", "d", "j"])
    empty = {f"{c}2": F.expr(f"slice({c}1, 1, 0)") for c in ("id", "w", "v", "p")}
    cols = [f"{c}{s}" for s in "12" for c in ("id", "w", "v", "p")]
    found = apart.select(cols).union(second.filter("i = j").withColumns(empty).select(cols)).mapInArrow(_join(least), "id long, links long, other long")
    found = materialize(found, "ego-found")
    comp = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), "ego-cc")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    ids = ordered.select(*key, "id", "w", "low_id").join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    ids = materialize(ids.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("w") - 1, "comp": F.coalesce("comp", "id")}), "ego-ids")
    least_id = ids.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    known = ids.join(least_id, "comp").select(*key, "links", "component_id")
    plain = told.drop("v")
    cols = ["vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("h1").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")]
    out = plain.filter("h1 IS NOT NULL").join(known, key).select(*cols).union(plain.filter("h1 IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    out = materialize(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "ego-out")
    discard(classes, ordered, blocks, packed, found, comp, ids)
    return out


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, within their labels, from a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS k FROM embeddings),
x AS (
  SELECT * FROM r WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b, b.vec_id FROM x a JOIN x b ON a.label = b.label AND len(a.v) = len(b.v) AND a.k <> b.k AND list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(vec_id) AS low FROM c JOIN r ON r.k = c.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, CASE WHEN low < vec_id OR vec_id IS NULL AND low IS NOT NULL THEN low ELSE vec_id END AS component_id,
  NOT (low < vec_id IS TRUE OR vec_id IS NULL AND low IS NOT NULL) AS kept
FROM r LEFT JOIN n ON n.a = r.k LEFT JOIN m ON m.a = r.k
"""
