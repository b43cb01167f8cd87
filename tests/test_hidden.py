"""Hidden text by inherited style, against a walk over trees whose styles are known."""

import random

from quillon.operators import hidden as H

RULES = ["color:#fff", "color:#000", "visibility:hidden", "visibility:visible", "font-size:0", "font-size:1em", "display:none", "display:block", "opacity:0", "background:#000", "background:white", "text-indent:-9999px", "text-indent:0", "position:absolute;top:-5000px", "margin:0", ""]


def grow(rnd, depth=0):
    return [(rnd.choice(["div", "span", "b", "section"]), rnd.choice(RULES), grow(rnd, depth + 1)) if depth < 5 and rnd.random() < 0.6 else f"w{rnd.randrange(1000)} " for _ in range(rnd.randint(1, 4))]


def written(kids):
    return "".join(k if isinstance(k, str) else f'<{k[0]} style="{k[1]}">{written(k[2])}</{k[0]}>' for k in kids)


def nearest(chain, name, default):
    return next((v for rules in reversed(chain) for n, _, v in [r.partition(":") for r in rules.split(";")] if n == name), default)


def words(kids, chain=()):
    """(word, hidden) by looking from each word up through its ancestors."""
    for k in kids:
        if isinstance(k, str):
            gone = any(r in ("display:none", "opacity:0") or "top:-5000px" in r for r in chain)
            color, back = nearest(chain, "color", None), nearest(chain, "background", "white")
            yield k.strip(), gone or nearest(chain, "visibility", "visible") == "hidden" or nearest(chain, "font-size", "1") == "0" or nearest(chain, "text-indent", "0") == "-9999px" or color == "#fff" and back == "white" or color == back
        else:
            yield from words(k[2], (*chain, k[1]))


def test_style_is_that_of_the_nearest_declaration():
    rnd = random.Random(7)
    seen = 0
    for _ in range(400):
        tree = grow(rnd)
        p = H.Runs()
        p.feed(written(tree))
        p.close()
        got = [(w, reason is not None) for reason, parts in p.runs for w in "".join(parts).split()]
        want = list(words(tree))
        # a colour that nobody declared equals no background
        assert got == [(w, h) for w, h in want], written(tree)
        seen += sum(h for _, h in want)
    assert seen > 500


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, '<p hidden>x<b style="display:inline">y</b></p>z'), (3, "plain"), (4, "<script style='color:#fff'>no</script>"), (None, "<div style='OPACITY : 0 !important'>q" + "<p>" * 5000), (5, '<li style="color:white">a<li>b')]
    got = sorted((tuple(r) for r in H.hidden_runs(spark.createDataFrame(rows, "page_id long, html string")).collect()), key=str)
    assert got == sorted([(3, 0, "display", "xy"), (None, 0, "opacity", "q"), (5, 0, "colour", "a")], key=str)
    assert H.hidden_runs(spark.createDataFrame([], "page_id long, html string")).count() == 0
