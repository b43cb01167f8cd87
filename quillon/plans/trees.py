"""Queries over the node table of nested markup."""

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import nodes as N
from quillon.sources import sinks as K
from quillon.sources.tables import load

#: Containers that a match is addressed by.
HOLDERS = ["section", "heading", "paragraph", "item", "cell", "box", "note"]


@query("s03_node_table")
def node_table(spark, sf):
    """All nodes of all pages. No SQL: it needs a parser with implied ends; the tests compare with trees that are known."""
    return N.nodes(load(spark, sf, "pages")).drop("tag", "grid")


@query("t01_addressed_search")
def addressed_search(spark, sf):
    """Every 'the' of all pages with its address; the search reads the page's text nodes, menus and notes included."""
    return N.search(N.nodes(load(spark, sf, "pages"), kinds={"text"}, columns=["pre", "kind", "path", "text"]), "the", HOLDERS).drop("pre")


def nested_tables(spark, sf):
    """A page for each customer: a table of orders, in a cell of each a table of its lines."""
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("l"))
    row = F.transform(F.sort_array(F.collect_list("l")), lambda x: F.concat(F.lit("<tr><td>"), x["l_partkey"].cast("string"), F.lit("<td>"), x["l_returnflag"], F.lit(" "), x["l_linestatus"], F.lit("</td></tr>")))
    inner = lines.groupBy("o").agg(F.concat(F.lit("<table>"), F.array_join(row, ""), F.lit("</table>")).alias("t"))
    # parsing takes longer than its bytes suggest, so the parts stay as many as a shuffle has
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("o"), "o_orderstatus").join(inner, "o", "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    outer = F.transform(F.sort_array(F.collect_list(F.struct("o", "o_orderstatus", "t"))), lambda x: F.concat(F.lit("<tr><td>"), x["o"].cast("string"), F.lit("</td><td><p>"), x["o_orderstatus"], F.lit("</p>"), F.coalesce(x["t"], F.lit("")), F.lit("</td></tr>")))
    html = F.concat(F.lit("<div><h2>Orders</h2><table>"), F.array_join(outer, ""), F.lit("</table></div>"))
    return orders.groupBy("page_id").agg(html.alias("html"))


@query(
    "t01_nested_cells",
    """WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) - 1 AS INTEGER) AS r FROM orders),
    l AS (SELECT l_orderkey AS o, l_returnflag AS f, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS INTEGER) AS k FROM lineitem)
    SELECT page_id, '0000000:box/0000001:table/' || lpad(CAST(2 * r + 1 AS VARCHAR), 7, '0') || ':cell(' || r || ',1)/0000001:table/' || lpad(CAST(2 * k + 1 AS VARCHAR), 7, '0') || ':cell(' || k || ',1)' AS up_path,
      k AS up_row, 1 AS up_col, CAST(3 AS BIGINT) AS n_up, 0 AS "char" FROM o JOIN l USING (o) WHERE f = 'R'""",
)
def nested_cells(spark, sf):
    """Returned lines, found in cells of tables in cells, with the whole path."""
    tree = N.nodes(nested_tables(spark, sf), kinds={"text"}, columns=["pre", "kind", "path", "text"])
    return N.search(tree, "R", ["cell", "box"]).filter("up_kind = 'cell'").select("page_id", "up_path", "up_row", "up_col", "n_up", "char")


@query(
    "t19_nested_grid",
    """WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) - 1 AS INTEGER) AS r FROM orders),
    l AS (SELECT l_orderkey AS o, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS INTEGER) AS k FROM lineitem)
    SELECT page_id, r AS outer_row, k AS inner_row, CAST(l_partkey AS VARCHAR) AS text FROM o JOIN l USING (o)""",
)
def nested_grid(spark, sf):
    """First cells of inner tables, each with the row of the outer table that it stands in."""
    tree = N.nodes(nested_tables(spark, sf), kinds={"text"}, columns=["kind", "path", "text"])
    rows, cols = (F.regexp_extract_all("path", F.lit(r":cell\((\d+),(\d+)\)"), F.lit(n)) for n in (1, 2))
    cells = tree.filter("kind = 'text'").filter((F.size(cols) == 2) & (F.get(cols, F.lit(1)) == "0"))
    outer, inner = (F.get(rows, F.lit(i)).cast("int") for i in (0, 1))
    return cells.select("page_id", outer.alias("outer_row"), inner.alias("inner_row"), "text")


@query("k16_page_html")
def page_html(spark, sf):
    """All pages written again from their nodes. No SQL: the tests read what is written and get the same nodes."""
    return K.pages_html(load(spark, sf, "pages"))


@query(
    "k16_nested_html",
    """WITH l AS (SELECT l_orderkey AS o, string_agg('<tr><td>' || l_partkey || '</td><td>' || l_returnflag || ' ' || l_linestatus || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS t FROM lineitem GROUP BY 1)
    SELECT o_custkey AS page_id, '<div><h2>Orders</h2><table>' || string_agg('<tr><td>' || o_orderkey || '</td><td><p>' || o_orderstatus || '</p>' || coalesce('<table>' || t || '</table>', '') || '</td></tr>', '' ORDER BY o_orderkey, o_orderstatus) || '</table></div>' AS html
    FROM orders LEFT JOIN l ON o = o_orderkey GROUP BY 1""",
)
def nested_html(spark, sf):
    """Tables in tables from their nodes: the markup they were read from, with the ends that it had left out."""
    return K.pages_html(nested_tables(spark, sf))
