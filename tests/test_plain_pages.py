"""Plain pages, read and written in arrays, against Tree and the node table; large ones by what their plans leave out."""

import random

import pytest
from conftest import SF

from quillon.sources import nodes as N
from quillon.sources import plainpages
from quillon.sources import sinks as K

PIECES = [f"<{end}{tag}>" for tag in ("div", "p", "td", "tr", "table", "li", "ul", "h2", "b", "tbody", "details", "dt", "dd", "dl", "th", "section") for end in ("", "/")]
PIECES += ["<br>", "<a href=\"x\">", "</a>", "<p class='a b'>", "x", "a > b", " ", "&amp;", "&lt;b", "é \n y", "&", "&am", "p;", "the the", "aaaa"]
ODD = ["<!-- c -->", "<script>var a='<p>'</script>", "<P>", "<p/>", "<p a=b>", "<", "<x-y>", "<br/>", "</", "<img src='x'>", "<title>", "<p\n>", "<ul a=\"x\"b='y'>"]


@pytest.fixture(scope="module")
def markup():
    rnd = random.Random(7)
    plain = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    odd = ["".join(rnd.choice(PIECES + ODD) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    deep = ["<table><tr><td>x" * 10 + "<details>secret<p>q</details>" + "</table>" * 4, "<div>" * (plainpages.DEEPEST + 1) + "x", "<table>" + "<tr><td>x<td>y" * 40_000]
    return plain + odd + deep


@pytest.fixture(scope="module")
def pages(spark, markup):
    return spark.createDataFrame(list(enumerate(markup)), "page_id int, html string").repartition(4)


def tree(html):
    t = N.Tree()
    t.feed(html)
    t.close()
    return t.rows


def test_nodes_are_those_of_tree(pages, markup):
    assert sum(plainpages.happenings(h) is not None for h in markup[:1500]) == 1500
    want = sorted((i, *map(str, r)) for i, h in enumerate(markup) for r in tree(h))
    got = N.nodes(pages).cache()
    assert sorted((r[0], *map(str, r[1:])) for r in got.collect()) == want
    some = N.nodes(pages, kinds={"text", "cell"}, columns=["path", "kind"])
    assert some.exceptAll(got.filter("kind IN ('text', 'cell')").select("page_id", "path", "kind")).isEmpty() and some.count() == got.filter("kind IN ('text', 'cell')").count()


def test_written_in_arrays_as_from_the_node_table(pages):
    for cap, held in ((K.NESTED, K.HELD), (1, ("table", "cell", "text", "box"))):
        want = K.nested_html(N.nodes(pages), cap=cap, held=held)
        got = K.pages_html(pages, cap=cap, held=held)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 1500
    assert K.pages_html(pages.limit(0)).count() == 0


def test_places_of_words(spark):
    texts = ["a the the", "thethe", "aaaaa the", "x" * 300 + " the aa" * 1000, "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    for word in ("the", "aa", "e"):
        want = []
        for i, t in enumerate(texts):
            at = t.find(word)
            while at >= 0:
                want.append((i, at))
                at = t.find(word, at + len(word))
        assert sorted((r["page_id"], r["char"]) for r in N.search(N.nodes(df), word, ["box"]).collect()) == want


@pytest.mark.parametrize("name", ["t01_nested_cells", "k16_nested_html"])
def test_nothing_is_shuffled_after_pages_are_read(spark, name):
    """All that is put together stands before the parser: no node or match is dealt out again, nor sorted."""
    from quillon.plans.registry import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    after = plan.split("MapInArrow")[0]
    assert "Exchange" not in after and "Window" not in after and "Aggregate" not in after


def test_plain_pages_take_no_walk(spark):
    """Pages of nested tables are read by moves and arrays, not by the walking parser."""
    from quillon.plans.trees import nested_tables

    found = [plainpages.happenings(r["html"]) for r in nested_tables(spark, SF).collect()]
    assert len(found) > 100 and all(f is not None for f in found)
