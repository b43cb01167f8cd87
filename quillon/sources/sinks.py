"""What is written: envelopes, page texts, Markdown, escaped XML, grids as CSV, with loss reports."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def envelope(rows: DataFrame, source: str, *columns: str) -> DataFrame:
    """One JSON line for each row: schemaVersion and source first, then the columns in order."""
    return rows.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(source).alias("source"), *columns), {"ignoreNullFields": "false"}).alias("line"))


def page_texts(paras: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page, text): lines of each page in order. A row is a page, so a long document is many rows."""
    got = paras.groupBy(id_col, "page").agg(F.sort_array(F.collect_list(F.struct("para", "text"))).alias("l"))
    return got.select(id_col, "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def xml_text(text: Column, attribute: bool = False) -> Column:
    """& < > always, quotes in attributes only."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markdown(paras: DataFrame, level: Column) -> DataFrame:
    """Lines as Markdown: headings by level, text as it is."""
    return paras.withColumn("markdown", F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).otherwise(F.col("text")))


def lean(rows: DataFrame, key: str, kept: tuple[str, ...], kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(what is exported, the loss report by kind): kinds that the target can't hold are dropped and reported."""
    keep = F.col(kind).isin(*kept)
    return rows.filter(keep), rows.filter(~keep).groupBy(kind).agg(F.count("*").alias("lost"))


def preserved(element: Column, known: Column, raw: Column) -> Column:
    """The element if the target can hold it, else a comment with what it was ('--' can't stand in one)."""
    return F.when(known, element).otherwise(F.concat(F.lit("<!-- "), F.replace(raw, F.lit("--"), F.lit("- -")), F.lit(" -->")))


def grid_csv(cells: DataFrame, table: str, row: str, columns: tuple[str, ...]) -> DataFrame:
    """A line of CSV for each row of a dense grid."""
    return cells.select(table, row, F.to_csv(F.struct(*columns)).alias("line"))


def csv_grid(lines: DataFrame, table: str, row: str, schema: str) -> DataFrame:
    return lines.select(table, row, F.from_csv("line", schema).alias("c")).select(table, row, "c.*")


def grid_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, steps: int = 512) -> Column:
    """Four numbers on a grid of so many steps."""
    at = lambda v, whole: F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor(v * steps / whole))).cast("int")
    return F.array(at(x, page_w), at(y, page_h), at(x + w, page_w), at(y + h, page_h))


def write_atomically(path: str, content: bytes) -> None:
    """Replaces a file's bytes all at once: a sibling file is written and synced, then takes its place. If
    anything fails the old bytes stay, and no sibling is left. For single files, such as manifests; tables are
    committed by Spark's own writers."""
    folder, name = os.path.split(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(prefix=f".{name}.", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.remove(temporary)
        raise


def verified(rows: DataFrame, path: str) -> DataFrame:
    """(identical, diff_count, error): writes rows as Parquet, reads them again and compares both as multisets. What can't
    be read again has failed."""
    from pyspark.errors import PySparkException

    from quillon.operators.diff import identical

    rows.write.mode("overwrite").parquet(path)
    try:
        return identical(rows, rows.sparkSession.read.parquet(path)).withColumn("error", F.lit(None).cast("string"))
    except PySparkException as e:
        return rows.sparkSession.createDataFrame([(False, None, type(e).__name__)], "identical boolean, diff_count long, error string")


#: Tables in tables in tables that are written out, and kinds of nodes that the clipboard holds.
NESTED, HELD = 8, ("section", "heading", "paragraph", "list", "item", "table", "cell", "box", "link", "text")


def _written(get, cap: int, held: tuple[str, ...]) -> tuple[Column, Column]:
    """Of a node whose columns get gives: whether it is written, and its start and end as (at, start, until, close), by their places among
    all starts and ends of the page: before a node's start stand as many starts as its pre and the ends of those that aren't its ancestors."""
    path, kind = get("path"), get("kind")
    tables = F.when(get("depth") < cap, 0).otherwise(((F.length(path) - F.length(F.replace(path, F.lit(":table/"), F.lit("")))) / len(":table/")).cast("int"))
    keep = (get("depth") < cap) | (tables <= cap)
    # an ancestor of another kind: a part of the path, but its last, that doesn't go on as one of these
    keep &= ~path.rlike(rf":(?!(?:{'|'.join(map(re.escape, held))})[(/])[^/]*/")
    out = F.when(~kind.isin(*held), kind).when((kind == "table") & (tables == cap), F.lit(f"table nested deeper than {cap}"))
    # a row of cells begins with its first one, and ends before the next row or with its table
    first = F.when((kind == "cell") & (get("col") == 0), F.when(get("row") > 0, "</tr><tr>").otherwise("<tr>")).otherwise("")
    start = F.when(kind == "text", xml_text(get("text"))).otherwise(F.concat(first, F.lit("<"), get("tag"), F.lit(">")))
    close = F.when(kind == "text", "").otherwise(F.concat(F.when(get("grid"), "</tr>").otherwise(""), F.lit("</"), get("tag"), F.lit(">")))
    left = F.concat(F.lit("<!-- "), out, F.lit(" -->"))
    at, until = get("pre") * 2 - get("depth"), get("post") * 2 + get("depth") + 1
    return keep, F.struct(at.alias("at"), F.coalesce(left, start).alias("start"), until.alias("until"), F.when(left.isNotNull(), "").otherwise(close).alias("close"))


def _joined(nodes: Column) -> Column:
    """The page that these (at, start, until, close) are of: their pieces in one sort."""
    piece = lambda at, text: F.struct(at.alias("at"), text.alias("text"))
    pieces = F.concat(F.transform(nodes, lambda n: piece(n["at"], n["start"])), F.transform(F.filter(nodes, lambda n: n["close"] != ""), lambda n: piece(n["until"], n["close"])))
    return F.array_join(F.transform(F.sort_array(pieces), lambda p: p["text"]), "")


def nested_html(tree: DataFrame, id_col: str = "page_id", cap: int = NESTED, held: tuple[str, ...] = HELD) -> DataFrame:
    """(id_col, html) from the node table: every node's start and end as pieces in the order of the page, put together in one
    sort, with no walk. In place of a table inside cap others, and of a node of another kind, stands a comment that says what is
    left out; what is inside them is left out with them. A page is a value, so it fits a row; pages without nodes have none."""
    keep, node = _written(F.col, cap, held)
    got = tree.filter(keep).select(id_col, node.alias("n")).groupBy(id_col).agg(F.collect_list("n").alias("n"))
    return got.select(id_col, _joined(F.col("n")).alias("html"))


#: Columns of the node table that pages are written from.
WRITTEN = ["pre", "post", "depth", "kind", "tag", "path", "row", "col", "text", "grid"]


def pages_html(pages: DataFrame, id_col: str = "page_id", markup: str = "html", cap: int = NESTED, held: tuple[str, ...] = HELD) -> DataFrame:
    """nested_html of the nodes of pages, a row for each page that has nodes: what is read whole in a task is written there, in arrays, and
    no piece is shuffled."""
    from quillon.sources.nodes import each_page

    return each_page(pages, lambda sizes, nodes: _markup(sizes, nodes, cap, held), "html string", WRITTEN, id_col, markup)


def _markup(sizes, nodes: dict[str, pa.Array], cap: int, held: tuple[str, ...]) -> pa.Array:
    """The pages that nodes are of, page after page: the rules of _written, and every piece laid at its place."""
    kind, tag, path = nodes["kind"], nodes["tag"], nodes["path"]
    pre, post, depth = (nodes[c].to_numpy().astype(np.int64) for c in ("pre", "post", "depth"))
    text = pc.equal(kind, "text")
    kept, left = np.ones(len(kind), bool), pa.nulls(len(kind), pa.string())
    known = pc.is_in(kind, pa.array(held))
    if not pc.all(known).as_py():
        up = pc.count_substring_regex(path, rf":(?:{'|'.join(map(re.escape, held))})(?:\([0-9]+,[0-9]+\))?/")
        kept &= up.to_numpy() == depth
        left = pc.if_else(known, left, kind)
    if depth.max(initial=0) >= cap:
        tables = pc.count_substring(path, ":table/")
        kept &= tables.to_numpy() <= cap
        deep = pc.and_(pc.equal(kind, "table"), pc.equal(tables, cap))
        left = pc.if_else(pc.and_(deep, known), f"table nested deeper than {cap}", left)
    told = nodes["text"]
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        told = pc.replace_substring(told, a, b)
    begins = pc.fill_null(pc.and_(pc.equal(kind, "cell"), pc.equal(nodes["col"], 0)), False)
    first = pc.if_else(begins, pc.if_else(pc.fill_null(pc.greater(nodes["row"], 0), False), "</tr><tr>", "<tr>"), "")
    start = pc.if_else(text, told, pc.binary_join_element_wise(first, "<", tag, ">", ""))
    close = pc.binary_join_element_wise(pc.if_else(nodes["grid"], "</tr>", ""), "</", tag, ">", "")
    if left.null_count < len(left):
        start = pc.coalesce(pc.binary_join_element_wise("<!-- ", left, " -->", ""), start)
    ended = kept & ~text.to_numpy(zero_copy_only=False) & left.is_null().to_numpy(zero_copy_only=False)
    # starts and ends of a page fill its places without gaps
    sizes = np.asarray(sizes)
    base = 2 * np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = np.full(2 * len(kind), -1)
    piece[(base + 2 * pre - depth)[kept]] = np.flatnonzero(kept)
    piece[(base + 2 * post + depth + 1)[ended]] = np.flatnonzero(ended) + len(kind)
    there = np.concatenate([[0], np.cumsum(piece >= 0)])[np.concatenate([[0], 2 * np.cumsum(sizes)])]
    pieces = pa.concat_arrays([start, close]).take(pa.array(piece[piece >= 0]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(there, pa.int32()), pieces), "")
