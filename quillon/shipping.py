"""Puts this package on the executors, for operators that run Python there."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Ships the package once for each context, so workers import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon-ship.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(archive)
        sc._quillon_shipped = archive
    return spark


#: Rows and bytes of an Arrow batch for functions on whole texts, and Spark's own bound of rows that they take the place of.
BATCH_ROWS, BATCH_BYTES, DEFAULT_ROWS = 256, 64 << 20, "10000"


def bounded(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds Arrow batches, so that what a worker holds doesn't grow with the rows of its task, unless the
    caller has set bounds."""
    ship(spark)
    for key, default, value in (("maxRecordsPerBatch", DEFAULT_ROWS, BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in (default, None, "-1", "2147483647b", "9223372036854775807b"):
            spark.conf.set(key, str(value))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where none is set and all run in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Written tables of this context that later steps may still read; they go when the driver ends.
_written: list = []


def _remove_written() -> None:
    for sc, path in _written:
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112 - the context is gone, and with it whoever reads the table
            continue


def discard_later(spark: SparkSession, path: str) -> str:
    """path, which goes when the driver ends."""
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark.sparkContext, path))
    return path


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: plans stay short, and later readers survive lost executors."""
    spark = df.sparkSession
    path = discard_later(spark, f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
