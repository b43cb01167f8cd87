"""What every training-data operator needs from the session: table access, a shared
folder to cut lineage, the package on the executors, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import ship

#: Most rows in one Arrow batch. Texts are a few kilobytes, so a batch stays in the low megabytes.
BATCH_ROWS = 256
#: Bytes after which a batch ends, so that rows of many megabytes come a few at a time.
BATCH_BYTES = 64 << 20
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20


#: Spark's own bound of rows in an Arrow batch, which ours takes the place of.
_DEFAULT_ROWS = "10000"


def session(spark: SparkSession) -> SparkSession:
    """Ships this package to the executors once per context and bounds Arrow batches, by rows and by bytes, unless
    the caller has set bounds of their own."""
    ship(spark)
    for key, default, value in (("maxRecordsPerBatch", _DEFAULT_ROWS, BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in (default, None, "-1", "2147483647b", "9223372036854775807b"):
            spark.conf.set(key, str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where none is set and all run in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and every later
    reader sees the same rows even if an executor that made them is gone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    if not _left:
        atexit.register(_discard_left)
    _left[path] = spark.sparkContext
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Materialized tables that stand; results may still read them, so what no step discards goes when the driver ends.
_left: dict[str, SparkContext] = {}


def _delete(sc: SparkContext, path: str) -> None:
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in frames:
        _delete(df.sparkSession.sparkContext, df._quillon_path)
        _left.pop(df._quillon_path, None)


def _discard_left() -> None:
    for path, sc in _left.items():
        if sc._jsc is not None:  # a stopped context has no way to its files
            _delete(sc, path)


def planned_bytes(df: DataFrame) -> int:
    """The size that Spark's planner expects, from file sizes: no job; 0 where it knows nothing. It steers how
    work is cut, never results."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread, ways: int = 16, share: int = 256) -> DataFrame:
    """left joined with right (one row for each key) where a few keys may hold most of left: rows of a key with more
    than 1 / share of all - of which there are fewer than share, so they are broadcast - go ways ways by the hash
    of spread, and those keys' rows of right to all of them. left should be materialized: it is read twice."""
    total = left.count()
    hot = left.groupBy(*keys).count().filter(F.col("count") * share > max(total, share * 100)).select(*keys).limit(share).withColumn("_hot", F.lit(True))
    hot = F.broadcast(left.sparkSession.createDataFrame(hot.collect(), hot.schema))
    l = left.join(hot, keys, "left").withColumn("_s", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(ways))).otherwise(F.lit(0).cast("long"))).drop("_hot")  # noqa: E741
    r = right.join(hot, keys, "left").withColumn("_s", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return l.join(r, [*keys, "_s"]).drop("_s")


#: What operators hold in a Python worker between its tasks, and how to drop it. Workers live on from stage to
#: stage: one that turns to another operator gives back what the last one held.
_held: dict[str, Callable[[], None]] = {}


def turn_to(operator: str, drop: Callable[[], None] | None = None) -> None:
    """Says in a worker that a task of operator starts."""
    for other in [o for o in _held if o != operator]:
        _held.pop(other)()
    if drop is not None:
        _held[operator] = drop


def text_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def steps(col: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about STEP_BYTES each; a longer text is a step of its own."""
    _, offsets = text_parts(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
