"""Template entities: what fields a document with block markers has, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entities(marks: DataFrame, by: str, order: str, levels: int = 8) -> tuple[DataFrame, DataFrame]:
    """(by, path, field, repeated) and (by, error) from marks (kind 'body', 'block', 'end' or 'field', name) in order.

    A field belongs to the blocks that are open around it, outermost first; it repeats if there are any. Without
    markers all fields are top-level. A second body, an end without a block, a block without an end and
    nesting deeper than levels are errors, and a document with any gives no fields.
    """
    w = Window.partitionBy(by).orderBy(order)
    step = F.when(F.col("kind") == "block", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = marks.withColumn("depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    open_ = [F.last(F.when((F.col("kind") == "block") & (F.col("depth") == v), F.col("name")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in range(1, levels + 1)]
    rows = rows.withColumn("path", F.concat_ws("/", *[F.when(F.col("depth") >= v, c) for v, c in enumerate(open_, 1)]))
    sums = rows.groupBy(by).agg(F.count_if(F.col("kind") == "body").alias("bodies"), F.min("depth").alias("low"), F.max("depth").alias("high"), F.sum(step).alias("left"))
    error = F.when(F.col("bodies") > 1, "more than one body").when(F.col("low") < 0, "end without a block").when(F.col("left") > 0, "block without an end").when(F.col("high") > levels, "nested too deep")
    errors = sums.select(by, error.alias("error")).filter("error IS NOT NULL")
    fields = rows.filter("kind = 'field'").join(errors, by, "left_anti")
    return fields.select(by, "path", F.col("name").alias("field"), (F.col("depth") > 0).alias("repeated")).distinct(), errors
