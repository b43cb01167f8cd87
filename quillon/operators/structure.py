"""Outlines, gated clause trees, tables with spans, charts."""

from __future__ import annotations

import uuid

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import bounded

#: Marker patterns by level: chapter, section, article, paragraph number, item letter or digit.
ARTICLE, NUMBER, LETTER = r"^제([0-9]+)조(의[0-9]+)?", r"^([0-9]+)[.)] ", r"^([a-z])[.)] "
_DATE = re.compile(r"[0-9]{4}\. ?(0?[1-9]|1[0-2])\. ?(0?[1-9]|[12][0-9]|3[01])\.?")
_POINTS = {".": 1, "·": 1, "‥": 2, "…": 3}


def toc_row(text: str) -> bool:
    """A tab or a dotted leader worth three points, then page digits."""
    m = re.search(r"(\t|[.·‥… ]+)([0-9]+)\s*$", text)
    return bool(m) and ("\t" in m.group(1) or sum(_POINTS.get(c, 0) for c in m.group(1)) >= 3)


def marker_level(text: Column) -> Column:
    """1 for an article, 2 for a number, 3 for a letter; null for prose."""
    return F.when(text.rlike(ARTICLE), 1).when(text.rlike(NUMBER), 2).when(text.rlike(LETTER), 3)


def heading_level(text: Column) -> Column:
    """Level of an outline line: its leading '#'s."""
    n = F.length(F.regexp_extract(text, "^(#{1,6}) ", 1))
    return F.when(n > 0, n)


def parents(nodes: DataFrame, by: str, order: str, level: str, levels: int) -> DataFrame:
    """Adds parent: the nearest row before with a lower level, by window functions only."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == v, F.struct(F.col(order).alias("o"))), ignorenulls=True).over(w) for v in range(1, levels)]
    out = nodes
    for v, c in enumerate(last, 1):
        out = out.withColumn(f"_p{v}", c)
    best = F.greatest(*[F.when(F.col(level) > v, F.col(f"_p{v}.o")) for v in range(1, levels)], F.lit(None).cast(nodes.schema[order].dataType))
    return out.withColumn("parent", best).drop(*[f"_p{v}" for v in range(1, levels)])


def clause_rows(lines: list[str]) -> list[tuple[int, int | None, str]]:
    """(level, parent, kind) of each line: an item needs an open article, a sub-item an open item;
    full dates and contents rows are text, which stays with the last accepted clause."""
    out: list[tuple[int, int | None, str]] = []
    open_: dict[int, int] = {}
    for i, t in enumerate(lines):
        level = 1 if re.search(ARTICLE, t) else 2 if re.search(NUMBER, t) else 3 if re.search(LETTER, t) else 0
        if level and (_DATE.match(t) or toc_row(t)) or level > 1 and level - 1 not in open_:
            level = 0
        if not level:
            last = open_.get(max(open_)) if open_ else None
            out.append((0, last, "preamble" if last is None else "body"))
            continue
        open_ = {k: v for k, v in open_.items() if k < level}
        out.append((level, open_.get(level - 1), ("article", "item", "subitem")[level - 1]))
        open_[level] = i
    return out


def clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """clause_rows() of each text: acceptance changes what is open, so it is a fold over lines in order.
    A text is one row already, so nothing is shuffled; null texts have no lines."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is not None:
                    got = clause_rows(text.split("\n"))
                    out += [(n, *g) for n, g in enumerate(got)]
                    at += [i] * len(got)
            para, level, parent, what = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(para, pa.int32()), pa.array(level, pa.int32()), pa.array(parent, pa.int32()), pa.array(what, pa.string())], [id_col, "para", "level", "parent", "kind"])

    bounded(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, para int, level int, parent int, kind string")


def structure_mode(explicit: Column, clause: Column, numbers: Column) -> Column:
    """Explicit outline before strong clause markers before number lists."""
    return F.when(explicit, "outline").when(clause, "clause").when(numbers, "list").otherwise("none")


def expand_spans(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Anchor cells out to all positions they cover; token is anchor, left, up or cross. Spans of 0 count as 1."""
    rs, cs = F.greatest(F.col("row_span"), F.lit(1)), F.greatest(F.col("col_span"), F.lit(1))
    one = cells.select(*keys, F.col("row").alias("a_row"), F.col("col").alias("a_col"), "text", F.explode(F.sequence(F.lit(0), rs - 1)).alias("dr"), cs.alias("cs"))
    two = one.withColumn("dc", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    token = F.when((F.col("dr") == 0) & (F.col("dc") == 0), "anchor").when(F.col("dr") == 0, "left").when(F.col("dc") == 0, "up").otherwise("cross")
    return two.select(*keys, (F.col("a_row") + F.col("dr")).alias("row"), (F.col("a_col") + F.col("dc")).alias("col"), "a_row", "a_col", token.alias("token"), F.when(token == "anchor", F.col("text")).alias("text"))


def nesting(tables: DataFrame, depth: int = 8) -> DataFrame:
    """(table_id, depth) of tables (table_id, parent_id), from 0 at the top; those deeper than depth levels, and what hangs below
    nothing, are left out. A recursive query: a level is one join of the tables with the level above."""
    spark = tables.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # all of a level, however many; the levels are bounded
    view = f"quillon_tables_{uuid.uuid4().hex}"
    tables.select("table_id", "parent_id").createTempView(view)
    return spark.sql(f"""WITH RECURSIVE d(table_id, depth) AS (
      SELECT table_id, 0 FROM {view} WHERE parent_id IS NULL
      UNION ALL SELECT t.table_id, d.depth + 1 FROM {view} t JOIN d ON t.parent_id = d.table_id WHERE d.depth < {int(depth) - 1})
    SELECT table_id, depth FROM d""")


def export_tables(tables: DataFrame, cells: DataFrame, depth: int = 8) -> DataFrame:
    """Anchor cells of tables and of the tables inside them, with each table's address and depth.

    tables: table_id, parent_id (null at the top), rows, cols, section, paragraph; cells: table_id, row, col,
    row_span, col_span, text. Spans of 0 count as 1 and end with the table; anchors outside of their table are dropped,
    and so are tables deeper than depth. The grid is never spread out.
    """
    out = tables.join(nesting(tables, depth), "table_id")
    j = cells.join(out, "table_id").filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
    span = lambda s, at, n: F.least(F.greatest(F.col(s), F.lit(1)), F.col(n) - F.col(at))
    return j.select("table_id", "section", "paragraph", "depth", "row", "col", span("row_span", "row", "rows").alias("row_span"), span("col_span", "col", "cols").alias("col_span"), "text")
