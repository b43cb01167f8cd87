"""One table of all nodes of nested markup, so that no operator walks a tree.

A page is parsed once. Every element that the model knows becomes a row, as does every run of text directly inside one;
inline elements and unknown ones are passed through, scripts, styles and heads are left out. pre counts nodes as they
open, post as they close. With depth they give intervals: the subtree of a node holds the nodes with
pre < x.pre <= post + depth, so ancestors, containers and nested cells are range joins. path names a node among its siblings at
every level and sorts like the document.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.joins import contained
from quillon.shipping import ship

#: The kind of node that an element is.
KINDS = {
    "article": "section", "main": "section", "section": "section",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "p": "paragraph", "pre": "paragraph", "blockquote": "paragraph", "figcaption": "paragraph", "caption": "paragraph",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "td": "cell", "th": "cell",
    "div": "box", "aside": "box", "nav": "box", "header": "box", "footer": "box", "form": "box", "figure": "box",
    "a": "link", "details": "note",
}
#: What is no text of the page, and elements without an end.
HIDDEN = {"script", "style", "head", "template", "noscript"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: An element's start ends those of its own kind here that are open, up to the container.
ENDS = {"li": ({"li"}, {"ul", "ol", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr"}, {"table"})}
#: Width of an ordinal in a path, and nodes of one Arrow batch.
DIGITS, BATCH = 7, 50_000
BLOCKS = {"section", "heading", "paragraph", "list", "table", "box", "note"}
#: A block's start ends paragraphs up to one of those; the end of what isn't a part of the grid leaves the cell that it's in open.
PARAGRAPH, AROUND = {"p"}, {"td", "th", "table", "li", "div", "section", "article"}
CELLS, GRID, NOWHERE = {"td", "th"}, {"table", "tr", "tbody", "thead", "tfoot"}, (None, None)
SCHEMA = "pre int, post int, depth int, parent int, kind string, tag string, path string, row int, col int, text string, grid boolean"
NAMES, TYPES = [c.split()[0] for c in SCHEMA.split(", ")], [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]
KIND = NAMES.index("kind")


class Tree(HTMLParser):
    """rows: the nodes, in the order in which they close, as in SCHEMA."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.pre = self.post = 0
        self.hidden = 0
        # each: tag, pre or None if it's passed through, path, children so far, kind, (row, col), [row, col] of a table, whether it has cells
        self.open: list[list] = []
        # of those, the nodes and the tables
        self.held: list[list] = []
        self.tables: list[list] = []
        self.tops = 0
        self.text: list[str] = []

    def _place(self) -> tuple[str, int | None]:
        if not self.held:
            n, self.tops = self.tops, self.tops + 1
            return f"{n:0{DIGITS}}", None
        up = self.held[-1]
        n = up[3]
        up[3] = n + 1
        return f"{up[2]}/{n:0{DIGITS}}", up[1]

    def _flush(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            path, parent = self._place()
            self.rows.append((self.pre, self.post, len(self.held), parent, "text", None, path + ":text", None, None, t, False))
            self.pre += 1
            self.post += 1

    def _close(self) -> None:
        if self.text and self.open[-1][1] is not None:
            self._flush()
        tag, pre, path, _, kind, at, _, grid = self.open.pop()
        if pre is not None:
            held = self.held
            held.pop()
            if kind == "table":
                self.tables.pop()
            row, col = at or NOWHERE
            self.rows.append((pre, self.post, len(held), held[-1][1] if held else None, kind, tag, path, row, col, None, grid))
            self.post += 1

    def _end_until(self, tags: set, stop: set) -> None:
        """Closes up to the outermost open element of tags above the nearest one of stop."""
        at = i = len(self.open)
        for e in reversed(self.open):
            i -= 1
            if e[0] in stop:
                break
            if e[0] in tags:
                at = i
        while len(self.open) > at:
            self._close()

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append("\n")
            return
        kind = KINDS.get(tag)
        if tag in ENDS:
            self._end_until(*ENDS[tag])
        elif kind in BLOCKS:
            self._end_until(PARAGRAPH, AROUND)
        at = None
        if tag == "tr" and self.tables:
            grid = self.tables[-1][6]
            grid[0] += 1
            grid[1] = -1
        elif kind == "cell":
            grid = self.tables[-1][6] if self.tables else [0, -1]
            grid[0] = max(0, grid[0])
            grid[1] += 1
            at = tuple(grid)
        if kind is None:
            self.open.append([tag, None, None, 0, None, None, None, False])
            return
        if self.text:
            self._flush()
        path, _ = self._place()
        if at:
            path = f"{path}:{kind}({at[0]},{at[1]})"
            if self.held:
                self.held[-1][7] = True
        else:
            path = f"{path}:{kind}"
        e = [tag, self.pre, path, 0, kind, at, [-1, -1] if kind == "table" else None, False]
        self.open.append(e)
        self.held.append(e)
        if kind == "table":
            self.tables.append(e)
        self.pre += 1

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden and tag not in VOID:
            i = len(self.open)
            for e in reversed(self.open):
                i -= 1
                if e[0] == tag:
                    while len(self.open) > i:
                        self._close()
                    break
                if e[0] in CELLS and tag not in GRID:
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def close(self):
        super().close()
        while self.open:
            self._close()
        self._flush()


def _arrays(rows: list[tuple], columns: list[str]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True))
    return [pa.array(cols[NAMES.index(c)], TYPES[NAMES.index(c)]) for c in columns]


def _batches(batches, kinds: set[str] | None, columns: list[str], whole: bool):
    """(ids, places of pages among them, how many nodes each has, columns of the nodes), with about BATCH nodes at a time. Where pages
    needn't stay whole, those of more nodes are cut. Plain pages are read together, the others by Tree."""
    from quillon.sources import plainpages

    for b in batches:
        ids = b.column(0)
        at, rows, sizes = [], [], []
        plain, read, held = [], [], 0
        for i, text in enumerate(b.column(1)):
            text = text.as_py() or ""
            got = plainpages.happenings(text)
            # a long page goes through Tree, which is cut
            if got is not None and (whole or len(got[0]) <= BATCH):
                if got[0]:
                    plain.append(i)
                    read.append(got)
                    held += len(got[0])
                if held >= BATCH:
                    yield ids, plain, *plainpages.nodes(read, kinds, columns)
                    plain, read, held = [], [], 0
                continue
            tree = Tree()
            tree.feed(text)
            tree.close()
            found = tree.rows if kinds is None else [r for r in tree.rows if r[KIND] in kinds]
            step = max(1, len(found)) if whole else BATCH
            for lo in range(0, len(found), step):
                part = found[lo : lo + step]
                at.append(i)
                sizes.append(len(part))
                rows += part
                if len(rows) >= BATCH:
                    yield ids, at, sizes, _arrays(rows, columns)
                    at, rows, sizes = [], [], []
        if rows:
            yield ids, at, sizes, _arrays(rows, columns)
        if plain:
            yield ids, plain, *plainpages.nodes(read, kinds, columns)


def nodes(pages: DataFrame, id_col: str = "page_id", markup: str = "html", kinds: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """id_col, pre, post, depth, parent (its pre), kind, tag, path, row, col, text, grid (whether it has cells of its own) for each
    node of each page, parsed whole; of kinds and columns alone, where they are given, which numbers and paths don't depend on.

    text stands in nodes of kind text alone, with white space as one space; row and col in cells. End tags that may be left out are
    understood; elements still open close at the end. Null and empty pages have no nodes; repeated ids give the nodes of each.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    names = NAMES if columns is None else columns
    schema = ", ".join(SCHEMA.split(", ")[NAMES.index(c)] for c in names)

    def run(batches):
        for ids, at, sizes, cols in _batches(batches, kinds, names, False):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, sizes), pa.int64())), *cols], [id_col, *names])

    return pages.select(id_col, markup).mapInArrow(run, f"{id_col} {kind}, {schema}")


def each_page(pages: DataFrame, make, made: str, columns: list[str], id_col: str = "page_id", markup: str = "html") -> DataFrame:
    """id_col and a column made ("name type"): a row for each page that has nodes. make gets how many nodes each of some whole pages has and
    these columns of them as arrays, as nodes() gives them, and returns an array with a value for each page; so nothing is shuffled."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for ids, at, sizes, cols in _batches(batches, None, columns, True):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), make(sizes, dict(zip(columns, cols, strict=True)))], [id_col, made.split()[0]])

    return pages.select(id_col, markup).mapInArrow(run, f"{id_col} {kind}, {made}")


def ancestors(tree: DataFrame, of: DataFrame, kinds: list[str], id_col: str = "page_id", width: int = 64) -> DataFrame:
    """Each node of `of` with each of its ancestors of these kinds: its columns, and up_pre, up_kind, up_depth, up_path, up_row,
    up_col. A range join of places with intervals, by buckets of width places."""
    inner = F.col("post") + F.col("depth") > F.col("pre")
    spans = tree.filter(F.col("kind").isin(kinds) & inner).select(id_col, (F.col("pre") + 1).alias("up_lo"), (F.col("post") + F.col("depth")).alias("up_hi"), *[F.col(c).alias(f"up_{c}") for c in ("pre", "kind", "depth", "path", "row", "col")])
    return contained(of, spans, [id_col], "pre", "up_lo", "up_hi", width).drop("up_lo", "up_hi")


def cell_place(part: Column) -> tuple[Column, Column]:
    """Row and column of a cell from its part of a path; null for others."""
    return tuple(F.regexp_extract(part, r"\((\d+),(\d+)\)", n).try_cast("int") for n in (1, 2))


def nearest(of: DataFrame, kinds: list[str]) -> DataFrame:
    """Each node of `of` with its innermost ancestor of these kinds (nulls if none), and how many it has. A path names
    all ancestors, so nothing is joined; and two patterns find them in it, so none is taken apart."""
    fits = rf":(?:{'|'.join(map(re.escape, kinds))})(?:\([0-9]+,[0-9]+\))?" if kinds else "(?!)"
    up = F.nullif(F.regexp_extract("path", rf"^(.*{fits})/", 1), F.lit(""))
    part = F.substring_index(up, "/", -1)
    row, col = cell_place(part)
    kind = F.substring_index(F.substring_index(part, ":", -1), "(", 1)
    depth = F.length(up) - F.length(F.replace(up, F.lit("/"), F.lit("")))
    return of.select("*", F.regexp_count("path", F.lit(fits + "/")).cast("long").alias("n_up"), kind.alias("up_kind"), depth.alias("up_depth"), up.alias("up_path"), row.alias("up_row"), col.alias("up_col"))


def search(tree: DataFrame, word: str, kinds: list[str], id_col: str = "page_id") -> DataFrame:
    """A row for each place (char, from 0) where word stands in a text node: its path, the innermost container of these kinds
    with its path and cell, and how many such containers enclose it. Matches don't overlap."""
    hit = tree.filter((F.col("kind") == "text") & F.col("text").contains(word)).select(id_col, "pre", "path", F.split("text", F.lit("\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E")).alias("parts"))
    at = hit.select(id_col, "pre", "path", F.explode(F.when(F.size("parts") == 2, F.array(F.length(F.get("parts", F.lit(0))))).otherwise(_places(F.col("parts"), len(word)))).alias("char"))
    return nearest(at, kinds)


def _places(parts: Column, width: int, block: int = 256) -> Column:
    """Where words of this width stand between the parts: the k-th behind the parts before it and as many words. Lengths are summed by
    blocks, so that a text with many words takes no time by their square, and no window."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    size, blocks = F.size(parts), F.lit(block)
    lengths = F.transform(parts, lambda p: F.length(p))
    sums = F.transform(F.sequence(F.lit(0), ((size - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * blocks + 1, blocks)))
    before = F.transform(sums, lambda _, b: F.when(b > 0, total(F.slice(sums, F.lit(1), b))).otherwise(0))
    return F.transform(F.sequence(F.lit(0), size - 2), lambda k: F.get(before, (k / block).cast("int")) + total(F.slice(lengths, (k / block).cast("int") * blocks + 1, k % blocks + 1)) + k * width)
