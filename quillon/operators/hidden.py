"""Text that a reader doesn't see, by the style that holds where it stands.

Open elements are walked once. Colour, background, size, visibility and indentation are inherited: the nearest declaration
wins, so an element inside a hidden one may show its text again. display: none, full transparency, a hidden attribute and boxes
moved off the page can't be undone inside.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.shipping import ship
from quillon.sources.nodes import VOID, Tree

#: Lengths in pixels beyond which a box or a line stands off the page, and colours that are the page's own.
OFF = 900
WHITE = {"#fff", "#ffffff", "white", "rgb(255,255,255)", "rgba(255,255,255,1)"}
START = {"color": None, "back": None, "size": 1.0, "shown": True, "indent": 0.0, "gone": None}


def number(value: str) -> float | None:
    m = re.match(r"\s*(-?[0-9]*\.?[0-9]+)", value)
    return float(m[1]) if m else None


def styled(above: dict, attrs: dict) -> dict:
    """The style inside an element: what it declares, else what stands above."""
    s = dict(above)
    rules = {}
    for rule in (attrs.get("style") or "").split(";"):
        name, colon, value = rule.partition(":")
        if colon:
            rules[name.strip().lower()] = value.replace("!important", "").strip().lower()
    if "color" in rules and rules["color"] not in ("inherit", ""):
        s["color"] = rules["color"].replace(" ", "")
    for name in ("background", "background-color"):
        if rules.get(name, "inherit") not in ("inherit", "transparent", "none", ""):
            s["back"] = rules[name].replace(" ", "")
    if (n := number(rules.get("font-size", ""))) is not None:
        s["size"] = n
    if rules.get("visibility") in ("hidden", "collapse", "visible"):
        s["shown"] = rules["visibility"] == "visible"
    if (n := number(rules.get("text-indent", ""))) is not None:
        s["indent"] = n
    if s["gone"] is None:
        moved = rules.get("position") in ("absolute", "fixed") and any((n := number(rules.get(k, ""))) is not None and n <= -OFF for k in ("left", "top", "right", "bottom"))
        s["gone"] = "display" if rules.get("display") == "none" or "hidden" in attrs else "opacity" if number(rules.get("opacity", "")) == 0 else "off_page" if moved else None
    return s


def why(s: dict) -> str | None:
    """Why text of a style isn't seen; null if it is."""
    if s["gone"]:
        return s["gone"]
    if not s["shown"]:
        return "visibility"
    if s["size"] == 0:
        return "zero_size"
    if s["indent"] <= -OFF:
        return "off_page"
    if s["color"] == "transparent" or s["color"] in WHITE and (s["back"] is None or s["back"] in WHITE) or s["color"] is not None and s["color"] == s["back"]:
        return "colour"
    return None


class Runs(Tree):
    """runs: [reason, text] of stretches of text in order; what is no text of the page at all isn't among them."""

    def __init__(self):
        super().__init__()
        self.styles: list[dict] = []
        self.runs: list[list] = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if not self.hidden and tag not in VOID:  # elements that it ended are gone, and it stands last
            del self.styles[len(self.open) - 1 :]
            self.styles.append(styled(self.styles[-1] if self.styles else START, dict(attrs)))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        del self.styles[len(self.open) :]

    def handle_data(self, data):
        super().handle_data(data)
        if not self.hidden:
            reason = why(self.styles[-1] if self.styles else START)
            if self.runs and self.runs[-1][0] == reason:
                self.runs[-1][1].append(data)
            else:
                self.runs.append([reason, [data]])


def hidden_runs(pages: DataFrame, id_col: str = "page_id", markup: str = "html") -> DataFrame:
    """id_col, ord, reason, text: stretches of each page that aren't seen, with white space as one space; ord counts all stretches of
    the page that differ in why they are (not) seen. Pages without any have no rows, nor have null ones."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and re.search(r"(?i)style\s*=|\shidden", text):
                    p = Runs()
                    p.feed(text)
                    p.close()
                    for k, (reason, parts) in enumerate(p.runs):
                        words = " ".join("".join(parts).split())
                        if reason and words:
                            at.append(i)
                            rows.append((k, reason, words))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], [id_col, "ord", "reason", "text"])

    return pages.select(id_col, markup).mapInArrow(run, f"{id_col} {kind}, ord int, reason string, text string")
