"""Form objects: values by name, combo items out of a script, one chosen radio button in a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: control.InsertString("item", index)
INSERT = r'([A-Za-z_][A-Za-z0-9_]*)\.InsertString\("([^"]*)", ?([0-9]+)\)'


def combo_items(script: Column) -> Column:
    """array<struct<control, index, item>> of a script, sorted by control and index."""
    calls = F.regexp_extract_all(script, F.lit(INSERT), F.lit(0))
    part = lambda c, g: F.regexp_extract(c, INSERT, g)
    return F.array_sort(F.transform(calls, lambda c: F.struct(part(c, 1).alias("control"), part(c, 3).cast("int").alias("index"), part(c, 2).alias("item"))))


def set_values(objects: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """objects (keys, name, kind, group, value) after sets (keys, name, value, seq): the last set of a name wins, and a
    radio button that is set to 1 takes it from the others of its group. Push buttons keep their value."""
    last = sets.groupBy(*keys, "name").agg(F.max(F.struct("seq", "value")).alias("s"))
    rows = objects.join(last, [*keys, "name"], "left")
    chosen = rows.filter("kind = 'radio' AND s.value = '1'").groupBy(*keys, "group").agg(F.max(F.struct("s.seq", "name"))["name"].alias("chosen"))
    rows = rows.join(chosen, [*keys, "group"], "left")
    value = (
        F.when(F.col("kind") == "button", F.col("value"))
        .when((F.col("kind") == "radio") & F.col("chosen").isNotNull(), F.when(F.col("name") == F.col("chosen"), "1").otherwise("0"))
        .otherwise(F.coalesce("s.value", "value"))
    )
    return rows.select(*keys, "name", "kind", "group", value.alias("value"))
