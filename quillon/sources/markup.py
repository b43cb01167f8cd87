"""HTML in: cells with the bounds that a parser finds, nested tables apart, and links."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.shipping import ship

#: Tables in tables in tables: deeper ones are left out.
DEPTH = 8


class Tables(HTMLParser):
    """rows: (table, parent table, depth, row, col, row_span, col_span, text) of each cell, tables numbered as they open.
    A cell's text leaves out that of tables inside it. Cells and rows end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.count = 0
        self.rows: list[tuple] = []

    def _end_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is not None and len(self.open) <= DEPTH:
            row, col, spans, text = t["cell"]
            self.rows.append((t["n"], t["up"], len(self.open) - 1, row, col, *spans, " ".join("".join(text).split())))
        t["cell"] = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"n": self.count, "up": self.open[-1]["n"] if self.open else None, "row": -1, "col": -1, "cell": None})
            self.count += 1
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1].update(row=self.open[-1]["row"] + 1, col=-1)
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            t = self.open[-1]
            t["row"] = max(0, t["row"])
            t["col"] += 1
            a = dict(attrs)
            span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdecimal() else 1
            t["cell"] = (t["row"], t["col"], (span("rowspan"), span("colspan")), [])

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._end_cell()
        elif self.open and tag == "table":
            self._end_cell()
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][3].append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_cell()
            self.open.pop()


def cells(pages: DataFrame, id_col: str, markup: str) -> DataFrame:
    """A row for each table cell of each page; null pages have none."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "table", "parent", "depth", "row", "col", "row_span", "col_span", "text"]

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and "<t" in text.lower():
                    p = Tables()
                    p.feed(text)
                    p.close()
                    out += p.rows
                    at += [i] * len(p.rows)
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string() if j == 7 else pa.int32()) for j, c in enumerate(cols))], names)

    return pages.select(id_col, markup).mapInArrow(run, f"{id_col} {kind}, table int, parent int, depth int, row int, col int, row_span int, col_span int, text string")
