"""Training-data operators on inputs of which earlier versions left parts out."""

import random

from pyspark.sql import functions as F

from quillon.llm import decontam, htmlmain

PAGES = ["<nav><a>x y</a></nav><article><p>a b c</p></article><footer>z</footer>"] * 5


def test_main_text_region_decides_bounds():
    w = htmlmain.learn(PAGES)
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    nav, foot = "<nav><a>Home</a></nav>", "<footer>end</footer>"
    two = f"{nav}<article><p>one {words(9)}</p></article><div class='ad'>buy</div><article><p>two {words(9)}</p></article>{foot}"
    assert htmlmain.extract(two, w) == f"one {words(9)}\ntwo {words(9)}"
    long_first = f"{nav}<article><p>one {words(30)}</p></article><article><p>two {words(9)}</p></article>{foot}"
    assert htmlmain.extract(long_first, w) == f"one {words(30)}\ntwo {words(9)}"
    main = f"{nav}<main><article><p>one {words(30)}</p></article><section><p>two {words(9)}</p></section></main>{foot}"
    assert htmlmain.extract(main, w) == f"one {words(30)}\ntwo {words(9)}"
    # the ends of an article that the region leaves off are in the text; a far element that it doesn't touch isn't
    ends = f"{nav}<article><p>x</p>{'<i></i>' * 40}<p>one {words(30)}</p>{'<i></i>' * 40}<p>y</p></article>{'<ul><li></li></ul>' * 90}<section><p>far</p></section>{foot}"
    assert htmlmain.extract(ends, w) == f"x\none {words(30)}\ny"


def test_decontamination_without_words_and_to_the_bound(spark):
    rng = random.Random(2)
    cjk = lambda n: "".join(chr(0x4E00 + rng.randrange(600)) for _ in range(n))
    latin = lambda n: "".join(rng.choice("abcdefghiklmnoprstuw     ") for _ in range(n))
    items = [cjk(rng.randrange(30, 90)) for _ in range(40)] + [latin(rng.randrange(60, 400)) for _ in range(60)]

    def edited(text, rate, letter):
        return "".join(c if rng.random() >= rate else rng.choice(("", letter(1), c + letter(1))) for c in text)

    docs = [cjk(200) + edited(t, i % 3 * 0.06, cjk) + cjk(200) for i, t in enumerate(items[:40])]
    docs += [latin(300) + " " + edited(t, rng.choice((0.1, 0.14, 0.18)), latin) + " " + latin(300) for t in items[40:]]
    body = [decontam.squeeze(d).encode() for d in docs]
    want = {(d, i): dist for d, t in enumerate(body) for i, x in enumerate(items) if (dist := decontam.best_place(b := decontam.squeeze(x).encode(), t)[0]) * 100 <= 20 * len(b)}
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(want) > 80 and set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(want[k] == d for k, d in got.items())


def test_pipeline_drops_copies_at_five_words_and_80_percent(spark):
    import corpus_pipeline as C

    w = [f"w{i}" for i in range(100)]
    # 96 five-word n-grams and 20 more: a Jaccard similarity of 96 / 116
    rows = [(1, " ".join(w)), (2, " ".join(w + [f"x{i}" for i in range(20)])), (3, " ".join(w + [f"y{i}" for i in range(30)]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_main_text_of_pages_without_markers():
    w = htmlmain.learn(PAGES)
    text = " ".join(f"w{i}" for i in range(60))
    nav, foot = "<nav><a>Home</a></nav>", "<footer>f</footer>"
    want = {
        f'<body><p class="share">Share<p>Real {text}<p>more</body>': f"Real {text}\nmore",
        f'<body>{nav}<div id="content" class="has-sidebar"><p>{text}</p></div>{foot}': text,
        f'<body>{nav}<div class="article-with-comments"><p>{text}</p><div id="comments"><p>{text} {text}</p></div></div>{foot}': text,
        f'<body><ul><li class="menu-item">Home<li class="menu-item">About</ul><div><p>{text}</p></div>{foot}': text,
        f'<body><form action="/x">{nav}<div><p>{text}</p></div></form></body>': text,
        f'<body>{nav}<div class="post"><p>{text}</p><div class="post-share">share it</div><p>end</p></div><div class="entry-comments"><p>{text}</p></div>{foot}': f"{text}\nend",
        f"<body>{nav}<div class='ad'>buy<article><p>{text}</p></article>{foot}": text,
        f"<body>{nav}<div class='ad'>{text}</div><article><h1>T</h1></article>{foot}": "T",
        f"<body>{nav}<div class='widget'><p>{text}</p></div>{foot}": text,
        f"<body>{nav}<div class='ad'>buy this now</div>{foot}": "",
        f"<body><table><tr><td class=sidebar>links<td><p>{text}</table>{foot}": text,
        f"<body>{nav}<form><input name=q></form><p>{text}<form>news</form><p>end</p>{foot}": f"{text}\nend",
    }
    for page, found in want.items():
        assert htmlmain.extract(page, w) == found, page


def test_main_text_in_linear_time_and_against_all_regions():
    import time

    w = htmlmain.learn(PAGES)
    for part in ("<li class=menu>x<h1>", "<b>", "<p>a", "<div class=ad>", "</p><b><div></div>", "<td>x<table>", "<select><option>a"):
        t = time.perf_counter()
        htmlmain.extract(part * (200_000 // len(part)), w)
        assert time.perf_counter() - t < 10, part
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<div>", "</div>", "a b c", "x", "<li>", "<a>", "</a>", "<br>", "<nav>m</nav>", "<h1>"]
    for _ in range(150):
        toks = htmlmain.tokens("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))))
        points = [htmlmain.value(t, f, n, w) for t, (f, n) in zip(toks, htmlmain._features(toks))]
        lo, hi = htmlmain.region(toks, w)
        best = max([0.0, *(sum(points[i:j]) for i in range(len(points)) for j in range(i + 1, len(points) + 1))])
        assert abs(sum(points[lo:hi]) - best) < 1e-9


def test_main_text_of_all_pages_without_their_markers(spark):
    from conftest import SF

    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    w = htmlmain.learn(pages)
    assert all(htmlmain.extract(p, w) == htmlmain.extract(p.replace("<article", "<div").replace("</article", "</div"), w) != "" for p in pages)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_judge_rows_not_ids(spark):
    """Null, repeated and shared ids, null and empty texts, extra columns with names that stages use inside."""
    from conftest import SF

    import corpus_pipeline as C

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (prose(90) for _ in range(5))
    near = a + " " + " ".join(f"x{i}" for i in range(8))
    row = lambda i, t: (i, t, "en", "s", None if t is None else len(t))
    rows = [row(1, a), row(1, b), row(2, a), row(2, a), row(3, near), row(None, b), row(None, c), row(None, c), row(None, d + " " + item), row(9, e + " " + item), row(9, c[::-1]), row(7, None), row(7, None), row(8, ""), row(None, "")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("_key", "_a", "_b", "_wordless", "sig", "n", "g", "rid", "item_id", "distance", "component_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept = C.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # a, its copies and near copies: one; b: that with an id; c: one of two; wordless ones all
    assert got == sorted([(1, a), (1, b), (None, c), (None, d + " " + item), (9, e + " " + item), (9, c[::-1]), (7, None), (7, None), (8, ""), (None, "")], key=str)
    clean = C.decontaminated(spark, docs, SF)
    assert clean.columns == docs.columns
    want = sorted(((i, t) for i, t, *_ in rows if not t or item not in t), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == want
    assert C.without_pii(spark, docs, SF).count() == len(rows) == C.tokens(spark, docs, SF).count()
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_decontamination_of_odd_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog by the river bank today"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (None, item.upper()), (2, None), (3, ""), (4, "x " * 200_000 + item)], "doc_id long, text string")
    for name in ("item_id", "first_word", "distance", "i", "t"):
        docs = docs.withColumn(name, F.lit("clash"))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "ab")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in decontam.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(1, 1, 0, 1), (1, 1, 0, 1), (1, 2, 0, 1), (1, 2, 0, 1), (None, 1, 0, 0), (None, 2, 0, 0), (4, 1, 0, 200_000), (4, 2, 0, 200_000)], key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)  # several passes
    again = sorted(((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in decontam.contaminated(docs, items).collect()), key=str)
    assert again == got
    assert decontam.contaminated(docs, items.limit(0)).count() == decontam.contaminated(docs.limit(0), items).count() == 0


def test_recall_of_decontamination_by_kind_and_share_of_edits(spark):
    """At least 0.9 of what an exact scan finds, for each kind of edit and share of edited places up to the bound."""
    rng = random.Random(21)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cjk = lambda n: "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(n))
    chars = lambda t, p, c: "".join(x if rng.random() >= p else rng.choice(("", c(), x + c())) for x in t)
    kinds = {
        "letters": (prose(40), lambda t, p: chars(t, p, lambda: rng.choice("etaoin "))),
        "words": (prose(40), lambda t, p: " ".join(rng.choice(words) if rng.random() < p else w for w in t.split())),
        "unspaced": (cjk(60), lambda t, p: chars(t, p, lambda: cjk(1))),
    }
    docs, items, cases = [], [], {}
    for kind, (_, edit) in kinds.items():
        for share in (0.06, 0.1, 0.14, 0.18):
            for _ in range(12):
                t = cjk(rng.randrange(30, 100)) if kind == "unspaced" else prose(rng.randrange(15, 60))
                pad = cjk(100) if kind == "unspaced" else prose(60)
                i = len(items)
                items.append(t)
                docs.append(pad + " " + edit(t, share) + " " + pad)
                near = decontam.best_place(decontam.squeeze(t).encode(), decontam.squeeze(docs[-1]).encode())[0]
                if near * 100 <= 20 * len(decontam.squeeze(t).encode()):
                    cases.setdefault((kind, share), []).append(i)
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(cases) >= 10
    for case, ids in cases.items():
        assert sum((i, i) in found for i in ids) >= 0.9 * len(ids), case


def test_decontamination_does_not_go_through_candidates_in_python():
    """Texts of the items' words share many runs of bytes with items that they don't hold: no calls for each of those."""
    import cProfile
    import pstats

    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = decontam.Items(list(range(60)), [prose(50) for _ in range(60)])
    texts = pa.array([prose(400) for _ in range(60)] + ["x " + items.bytes[7].decode()])
    calls = cProfile.Profile()
    calls.enable()
    found = list(decontam._windows(texts, items))
    calls.disable()
    assert (60, 7) in {x[:2] for x in found}
    assert pstats.Stats(calls).total_calls < 2 * len(found) + 20_000


def test_anchors_among_repeats_do_not_depend_on_the_order_of_hits():
    """Of two places in the text that share a run of bytes of the item, the last one is the anchor."""
    import numpy as np

    items = decontam.Items([1], ["abcdefgh"])
    for doc, place in ((0, 5), (0, 9)), ((0, 9), (0, 5)):
        hits = np.array([doc, place])
        got = decontam._anchors(hits[:, 0], hits[:, 1], np.zeros((2, 2), np.int64), items)
        assert [tuple(map(int, x)) for x in got] == [(0, 0, 9, 0)]


def test_salted_join_of_a_hot_key(spark):
    """A key with most rows goes many ways; rows without a partner are left out, as in any inner join."""
    from quillon.llm.runtime import salted

    left = spark.createDataFrame([("hot", i) for i in range(1500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", str(i)) for i in range(200)], "k string, w string")
    got = sorted(map(tuple, salted(left, right, ["k"], F.col("v")).select("k", "v", "w").collect()))
    assert got == sorted([("hot", i, "H") for i in range(1500)] + [(f"k{i}", i, str(i)) for i in range(200)])


def test_hot_groups_of_copies_and_of_near_copies(spark, monkeypatch):
    """A third of all rows are one text, another third near copies of one; n-grams crowd more than one task."""
    from quillon.llm import ngramjoin

    monkeypatch.setattr(ngramjoin, "CROWD", 10)
    rng = random.Random(31)
    prose = lambda n: [("w%d" % rng.randrange(4000)) for _ in range(n)]
    copy, base = prose(50), prose(120)
    texts = {i: " ".join(copy) for i in range(200)}
    for i in range(200, 400):
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        texts[i] = " ".join(w)
    texts |= {i: " ".join(prose(60)) for i in range(400, 600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.ngram_components(df).collect()}
    assert got == {i: 0 if i < 200 else 200 if i < 400 else i for i in texts}


def test_language_doesnt_depend_on_ids(spark):
    """Null ids, one id for all, repeated rows: predictions are those of the texts."""
    from conftest import SF

    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = lambda d: sorted(((r["text"], r["lang"]) for r in C.language(spark, d, SF).collect()), key=str)
    want = told(docs)
    assert len(want) > 150
    assert told(docs.withColumn("doc_id", F.lit(None).cast("long"))) == want == told(docs.withColumn("doc_id", F.lit(7).cast("long")))
    english = F.when(F.col("lang") == "en", F.lit(None).cast("long")).otherwise(F.col("doc_id"))
    assert told(docs.withColumn("doc_id", english)) == want
    assert told(docs.union(docs)) == sorted(want + want, key=str)
