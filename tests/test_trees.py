"""The node table against trees that are known, and its range joins against parent chains."""

import random

import pytest
from conftest import SF

from quillon.plans.trees import HOLDERS
from quillon.sources import nodes as N

#: Elements by what may stand in them.
BLOCKS = ["div", "section", "p", "ul", "table", "h2", "aside"]


def grow(rnd, depth=0):
    """(tag, children) with strings as text; inline elements are part of the text's markup only."""
    out = []
    for _ in range(rnd.randint(0, 4)):
        tag = rnd.choice(BLOCKS)
        if depth > 4 or rnd.random() < 0.4:
            out.append(rnd.choice(["one", "two the end", "a & b", "the"]) if not out or isinstance(out[-1], tuple) else ("h2", ["x"]))
        elif tag in ("p", "h2"):
            out.append((tag, ["in <b>the</b> line"]))
        elif tag == "ul":
            out.append((tag, [("li", grow(rnd, depth + 1)) for _ in range(rnd.randint(1, 3))]))
        elif tag == "table":
            out.append((tag, [[("td", grow(rnd, depth + 1)) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 2))]))
        else:
            out.append((tag, grow(rnd, depth + 1)))
    return out


def written(rnd, kids):
    """Markup, with end tags left out where they may be."""
    s = ""
    for k in kids:
        if isinstance(k, str):
            s += k if "<" in k else k.replace("&", "&amp;")
        elif isinstance(k, list):
            s += "<tr>" + "".join(written(rnd, [c]) for c in k) + rnd.choice(["</tr>", ""])
        else:
            tag, inner = k
            s += f"<{tag} class='x'>" + written(rnd, inner) + ("" if tag in ("td", "li") and rnd.random() < 0.5 else f"</{tag}>")
    return s


def walked(kids):
    """The rows that the tree should give, by a plain recursion."""
    rows, count = [], [0, 0]

    def go(kids, depth, parent, path):
        n = 0
        flat = []
        for r, k in enumerate(kids):
            flat += [(c, r, i) for i, c in enumerate(k)] if isinstance(k, list) else [(k, None, None)]
        for k, r, c in flat:
            pre = count[0]
            count[0] += 1
            here = f"{path}{'/' if path else ''}{n:07}"
            n += 1
            if isinstance(k, str):
                rows.append((pre, count[1], depth, parent, "text", here + ":text", None, None, k.replace("<b>", "").replace("</b>", "")))
            else:
                kind = N.KINDS[k[0]]
                here += f":{kind}" + (f"({r},{c})" if r is not None else "")
                go(k[1], depth + 1, pre, here)
                rows.append((pre, count[1], depth, parent, kind, here, r, c, None))
            count[1] += 1

    go(kids, 0, None, "")
    return sorted(rows)


@pytest.fixture(scope="module")
def pages(spark):
    trees = {}
    rnd = random.Random(4)
    for i in range(60):
        trees[i] = grow(rnd)
    df = spark.createDataFrame([(i, "<head><title>no</title></head>" + written(rnd, t) + "<script>var the = '<p>';</script>") for i, t in trees.items()], "page_id long, html string")
    return trees, N.nodes(df).cache()


def test_nodes_are_those_of_the_tree(pages):
    trees, got = pages
    by = {i: [] for i in trees}
    for r in got.collect():
        by[r["page_id"]].append((r["pre"], r["post"], r["depth"], r["parent"], r["kind"], r["path"], r["row"], r["col"], r["text"]))
    assert {i: sorted(v) for i, v in by.items()} == {i: walked(t) for i, t in trees.items()}
    assert sum(map(len, by.values())) > 500 and all([p for *_, p, _, _, _ in sorted(v)] == sorted(p for *_, p, _, _, _ in v) for v in by.values())


def test_ancestors_are_parent_chains(pages):
    trees, got = pages
    rows = {(r["page_id"], r["pre"]): r for r in got.collect()}
    want = set()
    for (i, pre), r in rows.items():
        up = r["parent"]
        while up is not None:
            if rows[i, up]["kind"] in ("cell", "box"):
                want.add((i, pre, up))
            up = rows[i, up]["parent"]
    for width in (1, 64):
        assert {(r["page_id"], r["pre"], r["up_pre"]) for r in N.ancestors(got, got, ["cell", "box"], width=width).collect()} == want


def test_search_addresses_matches(pages):
    trees, got = pages
    rows = {(r["page_id"], r["pre"]): r for r in got.collect()}
    want = []
    for (i, pre), r in rows.items():
        at = (r["text"] or "").find("the")
        while at >= 0:
            up, holders = r["parent"], []
            while up is not None:
                holders += [rows[i, up]] if rows[i, up]["kind"] in HOLDERS else []
                up = rows[i, up]["parent"]
            h = holders[0] if holders else None
            want.append((i, r["path"], at, len(holders), h["path"] if h else None, h["row"] if h else None))
            at = r["text"].find("the", at + 3)
    found = [(r["page_id"], r["path"], r["char"], r["n_up"], r["up_path"], r["up_row"]) for r in N.search(got, "the", HOLDERS).collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) > 50


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (3, "plain"), (4, "</div></p><td>x<td>y"), (None, "<div>" * 3000 + "deep"), (5, "a.b (a.b) A.B"), (6, "<p>x" * 20_000)]
    got = N.nodes(spark.createDataFrame(rows, "page_id long, html string"))
    by = {}
    for r in got.collect():
        by.setdefault(r["page_id"], []).append(r)
    assert set(by) == {3, 4, None, 5, 6} and len(by[3]) == 2 and len(by[6]) == 40_000
    # cells outside of a table stand alone
    assert sorted((r["row"], r["col"]) for r in by[4] if r["kind"] == "cell") == [(0, 0), (0, 0)] and max(r["depth"] for r in by[None]) == 3000
    assert sorted(r["char"] for r in N.search(got, "a.b", ["box"]).collect()) == [0, 5]
    assert N.nodes(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_whole_pages(spark):
    """Text nodes hold the pages' text: as many words as a plain stripping of tags leaves."""
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        from html import unescape

        h = re.sub(r"(?s)<head.*?</head>|<script.*?</script>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", r["html"])
        want[r["page_id"]] = sorted(unescape(re.sub(r"</?(?!b\b)[a-z][^>]*>", " ", h).replace("<b>", "").replace("</b>", "")).split())
    got = {}
    for r in N.nodes(pages).filter("kind = 'text'").collect():
        got.setdefault(r["page_id"], []).extend(r["text"].split())
    assert {k: sorted(v) for k, v in got.items()} == want


def test_written_again(spark, pages):
    """What is written from nodes reads as the same nodes."""
    from quillon.sources import sinks as K

    trees, got = pages
    again = N.nodes(K.nested_html(got))
    row = lambda r: (r["page_id"], r["pre"], r["post"], r["depth"], r["kind"], r["path"], r["row"] if r["kind"] == "cell" else None, r["text"])
    assert sorted(map(row, again.collect()), key=str) == sorted(map(row, got.collect()), key=str)


def test_what_is_left_out_is_said(spark):
    from quillon.sources import sinks as K

    deep = "<table><tr><td>x" * 4 + "<details>secret</details>&lt;b&gt;" + "</table>" * 4
    tree = N.nodes(spark.createDataFrame([(1, deep), (2, None), (3, "<details>a<p>b</p></details><p>c")], "page_id long, html string"))
    got = {r["page_id"]: r["html"] for r in K.nested_html(tree, cap=2).collect()}
    assert got == {1: "<table><tr><td>x<table><tr><td>x<!-- table nested deeper than 2 --></td></tr></table></td></tr></table>", 3: "<!-- note --><p>c</p>"}
    whole = {r["page_id"]: r["html"] for r in K.nested_html(tree).collect()}
    assert "<td>x<!-- note -->&lt;b&gt;</td>" in whole[1] and whole[1].count("<table>") == 4


def test_nesting(spark):
    from quillon.operators import structure

    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 6), (7, None)], "table_id long, parent_id long")
    depths = lambda n: sorted(map(tuple, structure.nesting(t, n).collect()))
    assert depths(8) == [(1, 0), (2, 1), (3, 2), (4, 3), (7, 0)] and depths(2) == [(1, 0), (2, 1), (7, 0)] and depths(1) == [(1, 0), (7, 0)]
    assert structure.nesting(t.limit(0)).count() == 0
