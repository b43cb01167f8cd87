"""Spelling variants of a vocabulary by errata-trie merging.

Words stand in tries. Every trie falls apart into heavy paths: from each node the child with the most words goes on, the
others are light. At a node v the errata trie takes in the light subtrees with their first character left out, the smaller
ones first, and each is walked together with what it may coincide with: the errata trie so far (one character replaced),
the heavy subtree (replaced), the subtree of v itself (skipped) and the grandchild that a skipped heavy character leads
to. Two terminals that coincide are words one edit apart, found once, at the node where they part. A word is copied for
its light edges alone, at most the logarithm of the number of words.

Tries are dealt out by the first PREFIX characters, which finds the pairs that agree there. The others differ near the front, so
they agree in their last SUFFIX characters and are found by the same tries over reversed words. A group of more than LIMIT
words isn't gathered: its top node is merged by joins (light words alone send probes), and the words go on to the groups of
the next character. Words of more than LONG characters would make deep tries; they meet by rolling hashes of themselves
with one character left out, linear in their length, and are compared exactly afterwards.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.oracles import crc32_sql
from quillon.llm.runtime import materialize, session, table, turn_to
from quillon.llm.textkernel import MULT, mix

#: Letters of which words are made, and those that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one trie, and characters of a word in a trie.
LIMIT, LONG = 10_000, 64
#: Leading characters that deal words to tries, and trailing ones of reversed words. A pair that parts within the first
#: PREFIX characters agrees in all but PREFIX characters of the shorter word, so words need PREFIX + SUFFIX at least.
PREFIX, SUFFIX = 3, 4


def planted(run: Column, doc_id: Column) -> Column:
    """run, without one code point where 31 divides the CRC of doc_id:run; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, errors: bool = False) -> DataFrame:
    """word, n: words of at least shortest code points that occur fewest times or more in all texts."""
    # a maximal run below the length gives no word whatever happens to it, so the pattern passes it over
    runs = docs.select(F.col(id_col).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("w"))
    runs = runs.select("i", F.translate("w", UPPER, LOWER).alias("w"))
    words = runs.select((planted(F.col("w"), F.col("i")) if errors else F.col("w")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def _walk(kids: list[dict], term: list[int], u: int, other: int, without: str | None, out: list) -> None:
    """Terminals that coincide below two nodes of one trie; without is a child of other that isn't walked."""
    if term[u] >= 0 and term[other] >= 0:
        out.append((term[u], term[other]))
    stack = [(x, y) for c, x in kids[u].items() if c != without and (y := kids[other].get(c)) is not None]
    while stack:
        a, b = stack.pop()
        if term[a] >= 0 and term[b] >= 0:
            out.append((term[a], term[b]))
        more = kids[b]
        for c, x in kids[a].items():
            y = more.get(c)
            if y is not None:
                stack.append((x, y))


def _merge(kids: list[dict], term: list[int], u: int, errata: dict, out: list) -> None:
    """Takes the subtree of u into an errata trie (dicts by character, terminals under None); what coincides is a pair."""
    stack = [(u, errata)]
    while stack:
        a, e = stack.pop()
        if term[a] >= 0:
            there = e.setdefault(None, [])
            out += [(term[a], t) for t in there]
            there.append(term[a])
        for c, x in kids[a].items():
            stack.append((x, e.setdefault(c, {})))


def trie_pairs(words: list[str], depth: int) -> list[tuple[int, int]]:
    """Pairs of places in words (distinct, alike in their first depth characters) that are one edit apart."""
    kids: list[dict] = [{}]
    term, size, up = [-1], [0], [-1]
    for i, w in enumerate(words):
        v = 0
        for c in w[depth:]:
            nxt = kids[v].get(c)
            if nxt is None:
                nxt = kids[v][c] = len(kids)
                kids.append({})
                term.append(-1)
                size.append(0)
                up.append(v)
            v = nxt
        term[v] = i
        size[v] = 1
    out: list[tuple[int, int]] = []
    for v in range(len(kids) - 1, 0, -1):  # nodes are numbered from above, so all below v are counted
        size[up[v]] += size[v]
    for v, own in enumerate(kids):
        if not own or len(own) == 1 and term[v] < 0:
            continue
        heavy = max(own, key=lambda c: size[own[c]])
        h = own[heavy]
        if term[v] >= 0 and term[h] >= 0:  # the word that ends here, with the heavy character inserted
            out.append((term[v], term[h]))
        errata: dict = {}
        lights = sorted((c for c in own if c != heavy), key=lambda c: size[own[c]])
        for c in lights:
            u = own[c]
            _walk(kids, term, u, h, None, out)
            _walk(kids, term, u, v, c, out)
            g = kids[h].get(c)
            if g is not None:
                _walk(kids, term, u, g, None, out)
            if len(lights) > 1:
                _merge(kids, term, u, errata, out)
    return out


def _bucket(depth: int):
    def run(t: pa.Table) -> pa.Table:
        turn_to("spelling")
        words = sorted(t["s"].to_pylist())
        a, b = [], []
        for _, own in groupby(words, key=lambda w: w[:depth]):
            own = list(own)
            for i, j in trie_pairs(own, depth) if len(own) > 1 else ():
                a.append(own[i])
                b.append(own[j])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return run


def _top(hot: DataFrame, depth: int) -> DataFrame:
    """The pairs that part at the top nodes of groups: light words probe for what they coincide with."""
    at = lambda a, n=None: F.substr("s", F.lit(a), F.lit(n)) if n else F.substr("s", F.lit(a))
    h = hot.select("s", at(1, depth).alias("p"), at(depth + 1, 1).alias("c"), at(depth + 2).alias("r"))
    heavy = h.filter("c <> ''").groupBy("p", "c").count().groupBy("p").agg(F.max(F.struct("count", "c"))["c"].alias("hc"))
    light = h.join(heavy, "p").filter("c <> hc")
    probes = light.select("s", F.explode(F.array(F.when(F.col("c") != "", F.concat("p", "hc", "r")), F.when((F.col("c") != "") & (F.substr("r", F.lit(1), F.lit(1)) != F.col("c")), F.concat("p", "r")), F.concat("p", "hc", "c", "r"))).alias("t"))
    found = probes.filter("t IS NOT NULL").join(hot.select(F.col("s").alias("t")), "t").select(F.col("s").alias("a"), F.col("t").alias("b"))
    one = light.filter("c <> ''").select("p", "r", "c", "s")
    both = one.join(one.toDF("p", "r", "c2", "s2"), ["p", "r"]).filter("c < c2")  # a row for each letter of the alphabet at most
    return found.union(both.select("s", "s2"))


def _grouped(words: DataFrame, n: int, depth: int, limit: int) -> list[DataFrame]:
    """Pairs (a, b) of words s that agree in their first depth characters."""
    out, cur = [], words
    while True:
        p = F.substr("s", F.lit(1), F.lit(depth)).alias("p")
        big = materialize(cur.groupBy(p).count().filter(F.col("count") > limit).select("p"), "errata-big")
        some = not big.isEmpty()
        fit = cur.withColumn("p", p).join(big, "p", "left_anti") if some else cur.withColumn("p", p)
        dealt = fit.select("s", F.pmod(F.xxhash64("p"), F.lit(max(64, 2 * n // limit))).alias("k"))
        out.append(dealt.groupBy("k").applyInArrow(_bucket(depth), "a string, b string"))
        if not some:
            return out
        hot = materialize(cur.withColumn("p", p).join(big, "p", "left_semi").select("s"), "errata-hot")
        out.append(_top(hot, depth))
        cur, depth = hot.filter(F.length("s") > depth), depth + 1


def _left_out(batches):
    """(wid, kind, at, key) for each distinct way to leave a character out of a word: kind 0 names the word itself, 1 what is
    left, 2 what is left and where."""
    turn_to("spelling")
    for b in batches:
        for wid, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(x), np.uint64(MULT)))])[: len(x)]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power)])
                left = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(MULT, -1, 1 << 64))
                _, first = np.unique(left, return_index=True)
                key = np.concatenate([mix(sums[-1:]), mix(left[first]), mix(left ^ mix(np.arange(len(x), dtype=np.uint64)))])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [1, len(first), len(x)])
            at = np.concatenate([[0], first, np.arange(len(x))])
            for lo in range(0, len(key), 1 << 16):
                hi = min(len(key), lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([wid] * (hi - lo), pa.int64()), pa.array(kind[lo:hi]), pa.array(at[lo:hi].astype(np.int32)), pa.array(key[lo:hi].view(np.int64))], ["wid", "kind", "at", "key"])


def _long_pairs(words: DataFrame, long: int) -> DataFrame:
    """Pairs of which one word has more than long characters."""
    w = materialize(words.filter(F.length("s") >= long).select(F.xxhash64("s").alias("wid"), "s"), "errata-long")
    keys = materialize(w.mapInArrow(_left_out, "wid long, kind int, at int, key long"), "errata-keys")
    of = lambda kind, *names: keys.filter(F.col("kind") == kind).select("key", "wid", "at").toDF("key", *names)
    gone = of(1, "x", "i").join(of(0, "y", "_"), "key").select("x", "y", "i", F.lit(False).alias("same"))
    other = of(2, "x", "i").join(of(2, "y", "j"), "key").filter("x < y AND i = j").select("x", "y", "i", F.lit(True).alias("same"))
    met = gone.union(other).join(w.toDF("x", "a"), "x").join(w.toDF("y", "b"), "y").filter(F.greatest(F.length("a"), F.length("b")) > long)
    cut = lambda c: F.concat(F.substr(c, F.lit(1), F.col("i")), F.substr(c, F.col("i") + 2))
    return met.filter((F.col("a") != F.col("b")) & (cut("a") == F.when(F.col("same"), cut("b")).otherwise(F.col("b")))).select("a", "b")


def near_pairs(words: DataFrame, limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """(a, b), once each, for all words (distinct, in column word) one code point apart; words have PREFIX + SUFFIX at least."""
    s = words.select(F.col("word").alias("s"))
    short = s.filter(F.length("s") <= long)
    n = short.count()
    ahead = _grouped(short, n, PREFIX, limit)
    back = _grouped(short.select(F.reverse("s").alias("s")), n, SUFFIX, limit)
    agree = F.substr("a", F.lit(1), F.lit(PREFIX)) == F.substr("b", F.lit(1), F.lit(PREFIX))
    turned = [p.select(F.reverse("a").alias("a"), F.reverse("b").alias("b")).filter(~agree) for p in back]
    found = ahead + turned
    if n < words.count():
        found.append(_long_pairs(s, long))
    out = found[0]
    for p in found[1:]:
        out = out.union(p)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, times: int = 10, errors: bool = False, limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word: its count, the number of words one edit away, the most frequent of
    those (ties: first in code-point order) if that is times as frequent or more, and where forms lead in the end.

    Null and empty texts have no words; repeated rows count again; a null id is an empty one where errors are planted; texts and
    words of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    if shortest < PREFIX + SUFFIX:
        raise ValueError(f"words need {PREFIX + SUFFIX} code points at least")
    session(docs.sparkSession)
    words = materialize(vocabulary(docs, id_col, text_col, shortest, fewest, errors), "errata-words")
    pairs = materialize(near_pairs(words, limit, long), "errata-pairs")
    sides = pairs.union(pairs.select("b", "a"))
    near = sides.join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("m"), F.col("b"))).alias("best"))
    known = words.join(near, "word", "left").withColumn("good", -F.col("best.m") >= times * F.col("n"))
    formed = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("good"), F.col("best.b")).alias("form"), F.when(F.col("good"), -F.col("best.m")).alias("form_n")), "errata-forms")
    # counts grow times-fold from form to form, which bounds the steps; each round doubles those that are done
    top = formed.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(max(top, 2)) / math.log(max(times, 2)))
    link = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps + 1)))):
        link = materialize(link.join(link.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "errata-roots")
    return formed.join(link, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, a few of which lose a character."""
    return variants(table(spark, sf_dir, "documents"), errors=True)


_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + (ord(ch) >> 6)::BIGINT, 128 + (ord(ch) & 63)::BIGINT] END))"
ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), '{UPPER}', '{LOWER}') AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS k FROM r GROUP BY doc_id, w),
h AS (SELECT w, k, {crc32_sql(_BYTES)} AS h FROM g),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
s AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM (SELECT a, b, n FROM p JOIN v ON v.word = b) GROUP BY a),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN s ON v.word = s.word),
t AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word JOIN f e ON e.word = t.root AND e.form IS NULL
"""
