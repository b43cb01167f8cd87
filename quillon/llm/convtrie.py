"""The trie of all conversations' prefixes.

Conversations are dealt out by the digest of their first turn; a task builds pointer tries (a dictionary of next turns at
each node) for the first turns of its share and sums up their subtrees in one iterative postorder. A first turn under which
more than LIMIT turns stand isn't gathered: the stretch that all its conversations share becomes rows of a table by one
aggregation, and what follows is dealt out anew by the next turn, until every part fits. Sums of such stretches come from
the tries below them, from the last round to the first.

Turns are rows with a digest throughout, so no row holds a conversation, and copies of a conversation are one path with a weight
before anything is dealt out.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.oracles import crc32_sql
from quillon.llm.runtime import materialize, session, table, turn_to

#: Turns below a first turn that one task takes, and conversation ids of one stretch of a digest.
LIMIT, IDS = 50_000, 4096
#: The SHA-256 of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
KEY = ["parent", "start", "top"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role: Column, text: Column) -> Column:
    """96 bits of a turn's speaker and text, as 16 characters."""
    return F.base64(F.unhex(F.substr(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(1), F.lit(24))))


def mixed(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its twenty."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos (from 1), key, words: turns by number (null first), equal numbers by speaker and digest."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    words = F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+"))
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), digest(r, t).alias("key"), words.cast("int").alias("words"))
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "key")
    return rows.select("conv_id", F.row_number().over(by).alias("pos"), "key", "words")


def rebuilt(rows: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """numbered rows with the first turns of a conversation taken from the first of its twenty; conversations
    without turns are left out."""
    convs = rows.groupBy("conv_id").count().withColumn("b", F.col("conv_id") - F.col("conv_id") % every)
    heads = rows.filter((F.col("conv_id") % every == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("b"), "pos", "key", "words")
    own = F.col("conv_id") == F.col("b")
    have = convs.filter(own).select("b", F.least(F.lit(most), "count").alias("have"))
    plan = convs.join(have, "b", "left").withColumn("h", F.when(own, 0).otherwise(mixed(F.col("conv_id"))))
    plan = materialize(plan.select("conv_id", "b", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("got")), "trie-plan")
    kept = rows.join(plan.select("conv_id", "h", "got"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).cast("int").alias("pos"), "key", "words")
    # at most every - 1 conversations meet at a head
    return kept.union(plan.filter("got > 0").join(heads, "b").filter("pos <= got").select("conv_id", "pos", "key", "words"))


def _hashes(batches):
    """(rep, sha) of comma-joined ids, from (rep, ids) in order of rep and of stretches; constant memory."""
    turn_to("convtrie")
    at, h = None, None
    for b in batches:
        reps, shas = [], []
        for rep, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if rep != at:
                if h is not None:
                    reps.append(at)
                    shas.append(h.hexdigest())
                at, h = rep, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], ["rep", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()])], ["rep", "sha"])


def id_digests(members: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of the ascending conv_ids of each rep. Ids come in stretches of at most IDS values; a task
    reads a rep's stretches in order and holds one at a time."""
    stretch = F.shiftright("conv_id", IDS.bit_length() - 1)
    ids = members.groupBy("rep", stretch.alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return ids.repartition("rep").sortWithinPartitions("rep", "s").select("rep", "ids").mapInArrow(_hashes, "rep long, sha string")


def build(conv: np.ndarray, pos: np.ndarray, key: list[str], words: np.ndarray, weight: np.ndarray, group: list[tuple]) -> dict[str, list]:
    """The nodes of a forest of tries. Rows are turns of paths, sorted by (conv, pos) and without gaps; group is (parent,
    start, first turn) of each row, start being the depth above the path's first row. The root of each trie is its first turn."""
    roots: dict[tuple, int] = {}
    kids: list[dict[str, int]] = []
    up: list[int] = []
    first: list[int] = []
    depth: list[int] = []
    above: list[int] = []
    own: list[int] = []
    n: list[int] = []
    ends: list[int | None] = []
    v, last = -1, None
    for i, (c, k) in enumerate(zip(conv.tolist(), key, strict=True)):
        begins = c != last
        table_, name = (roots, group[i]) if begins else (kids[v], k)
        if begins and last is not None:
            ends[v] = last
        nxt = table_.get(name)
        if nxt is None:
            nxt = table_[name] = len(kids)
            kids.append({})
            up.append(-1 if begins else v)
            first.append(c)  # paths come in order of their smallest conversation
            depth.append(int(pos[i]))
            above.append(group[i][0] if begins else first[v])
            own.append(int(words[i]))
            n.append(0)
            ends.append(None)
        n[nxt] += int(weight[i])
        v, last = nxt, c
    if last is not None:
        ends[v] = last
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for root in roots.values():
        stack = [(root, iter(kids[root].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[node] += not kids[node]
            saved[node] += (n[node] - 1) * own[node]
            if up[node] >= 0:
                leaves[up[node]] += leaves[node]
                saved[up[node]] += saved[node]
    return {"conv_id": first, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "top": [u < 0 for u in up]}


def _forest(t: pa.Table) -> pa.Table:
    turn_to("convtrie")
    t = t.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    group = list(zip(t["parent"].to_pylist(), t["start"].to_pylist(), t["top"].to_pylist(), strict=True))
    got = build(t["conv_id"].to_numpy(), t["pos"].to_numpy(), t["key"].to_pylist(), t["words"].to_numpy(), t["n"].to_numpy(), group)
    return pa.table({k: pa.array(v, pa.bool_() if k == "top" else pa.int64()) for k, v in got.items()})


def _shared(hot: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of groups that aren't gathered: a row for each turn that all their paths share (seg), and for each group its last one (cut)."""
    paths = hot.filter("pos = start + 1").groupBy(*KEY).agg(F.count("*").alias("paths"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    at = hot.groupBy(*KEY, "pos").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("c"), F.max("words").alias("words")).join(paths, KEY)
    parts = at.groupBy(*KEY).agg(F.min(F.when((F.col("low") != F.col("high")) | (F.col("c") < F.col("paths")), F.col("pos"))).alias("parts"), F.max("pos").alias("end"))
    cut = materialize(parts.join(paths, KEY).select(*KEY, "conv_id", "n_convs", F.coalesce(F.col("parts") - 1, "end").alias("cut")), name)
    seg = at.select(*KEY, "pos", "words").join(cut, KEY).filter("pos <= cut")
    return seg, cut


def prefix_trie(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The nodes below the root of the trie of numbered paths (conv_id, pos, key, words), and a row of the root's sums. Nodes
    of depth 1 have a null parent_conv_id."""
    per = rows.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("pos", "key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "key", "pos")).alias("h2"), F.count("*").alias("len"), F.min(F.when(F.col("pos") == 1, F.col("key"))).alias("top"))
    per = materialize(per, "trie-paths")
    same = materialize(per.groupBy("h1", "h2", "len", "top").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "trie-classes")
    total = same.agg(F.sum("len")).first()[0] or 0
    shas = id_digests(per.join(same, ["h1", "h2", "len", "top"]).select("rep", "conv_id"))
    # of copies one path goes on, with their number
    cur = materialize(rows.join(same.select(F.col("rep").alias("conv_id"), "n", "top"), "conv_id").withColumns({"parent": F.lit(None).cast("long"), "start": F.lit(0)}), "trie-turns")
    k = F.pmod(F.xxhash64(*KEY), F.lit(max(32, 4 * total // limit)))
    fits, rounds = [], []
    null_safe = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in KEY])
    while True:
        big = materialize(cur.groupBy(*KEY).count().filter(F.col("count") > limit).select(*KEY), "trie-big")
        some = not big.isEmpty()
        fit = cur.join(big, null_safe(cur, big), "left_anti") if some else cur
        out = fit.withColumn("k", k).groupBy("k").applyInArrow(_forest, NODE + ", top boolean")
        fits.append(materialize(out, "trie-nodes"))
        if not some:
            break
        hot = materialize(cur.join(big, null_safe(cur, big), "left_semi"), "trie-hot")
        hot = hot.withColumn("parent", F.coalesce("parent", F.lit(0)))  # the root's place: start 0 alone has it
        seg, cut = _shared(hot, "trie-cut")
        ends = hot.join(cut.select(*KEY, "cut"), KEY).groupBy(*KEY, "conv_id").agg(F.max("pos").alias("len"), F.max("cut").alias("cut")).filter("len = cut").select(*KEY, F.col("conv_id").alias("ends"), "cut")
        rounds.append(materialize(seg.withColumnRenamed("pos", "depth").join(ends.withColumnRenamed("cut", "depth"), [*KEY, "depth"], "left"), "trie-shared"))
        rest = hot.join(cut.select(*KEY, F.col("conv_id").alias("conv"), "cut"), KEY).filter("pos > cut")
        nexts = rest.filter("pos = cut + 1").select("conv_id", F.col("key").alias("top"))
        cur = materialize(rest.drop("top", "parent", "start").withColumnsRenamed({"conv": "parent", "cut": "start"}).join(nexts, "conv_id").select("conv_id", "pos", "key", "words", "n", "top", "parent", "start"), "trie-turns")
    below = reduce(DataFrame.union, fits)
    tops = below.filter("top").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("at")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count("*").alias("k"))
    tops = materialize(tops, "trie-tops")
    done, lower = [below.drop("top")], None
    for seg in reversed(rounds):
        got = tops if lower is None else tops.union(lower).groupBy("conv", "at").agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.sum("k").alias("k"))
        last = F.col("depth") == F.col("cut")
        whole = seg.join(got.select(F.col("conv").alias("conv_id"), F.col("at").alias("cut"), "l", "s", "k"), ["conv_id", "cut"], "left").na.fill(0, ["l", "s", "k"])
        down = Window.partitionBy(*KEY).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        nodes = whole.select(
            *KEY, "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("start") + 1, F.col("conv_id")).when(F.col("start") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("k")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.when(F.col("k") > 0, F.col("l")).otherwise(F.lit(1).cast("long")).alias("n_leaves"),
            (F.col("s") + F.sum((F.col("n_convs") - 1) * F.col("words")).over(down)).alias("saved_tokens"), "ends",
        )
        nodes = materialize(nodes, "trie-summed")
        heads = nodes.filter("depth = start + 1").groupBy(F.when(F.col("start") > 0, F.col("parent")).alias("conv"), F.col("start").cast("long").alias("at")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count("*").alias("k"))
        lower = heads
        done.append(nodes.drop(*KEY))
    roots = tops.filter("at = 0") if lower is None else tops.union(lower).filter("at = 0")
    root = roots.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("l"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("s"), F.lit(0)).alias("saved_tokens"))
    nodes = reduce(DataFrame.unionByName, done)
    # only nodes where something ends are looked up
    met = nodes.filter("ends IS NOT NULL").join(shas, nodes["ends"] == shas["rep"], "left").drop("rep")
    full = met.unionByName(nodes.filter("ends IS NULL").withColumn("sha", F.lit(NOTHING)))
    return full.withColumnRenamed("sha", "ends_sha256").select(COLUMNS), root


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mix: bool = False, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of
    all conversations' turns. A node is named by its smallest conversation and its depth; the root has no turn.

    With mix, a conversation takes its first turns from the first of its twenty. Turns go by number, null first;
    those that share a number go by speaker, then by digest; repeated rows are turns of their own. Null speakers and texts are
    empty. Rows without a conversation id take no part. An empty table gives no rows; other columns are ignored.
    """
    session(turns.sparkSession)
    rows = materialize(numbered(turns, conv, turn, role, text), "trie-rows")
    paths = materialize(rebuilt(rows), "trie-rebuilt") if mix else rows
    nodes, root = prefix_trie(paths, limit)
    every = rows.select("conv_id").distinct()
    empty = id_digests(every.join(paths.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("rep"), "conv_id"))
    # single rows: the root's values
    first, sums, ends = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first(), root.first(), empty.first()
    name = F.lit(first["conv_id"]).cast("long")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", name))
    if not first["n"]:
        return nodes
    row = (first["conv_id"], 0, None, first["n"], sums["n_children"], sums["n_leaves"], sums["saved_tokens"], ends["sha"] if ends else NOTHING)
    return nodes.unionByName(nodes.sparkSession.createDataFrame([row], ", ".join(f"{c} {'string' if c == COLUMNS[-1] else 'long'}" for c in COLUMNS)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with first turns mixed within each twenty."""
    return conversation_trie(table(spark, sf_dir, "conversations"), mix=True)


_BYTES = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS b, {crc32_sql(_BYTES)} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
m AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.b AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
o AS (
  SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path
  FROM c LEFT JOIN m ON m.conv_id = c.conv_id GROUP BY c.conv_id),
x AS (SELECT conv_id, d, list_slice(path, 1, d) AS p, len(path) AS n FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM o)),
n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ids
  FROM x GROUP BY p, d),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^ \\t-\\r]+')) END AS words, list_slice(p, 1, d - 1) AS q FROM n),
k AS (SELECT q, d - 1 AS d, count(*) AS k FROM w WHERE d > 0 GROUP BY q, d),
y AS (SELECT w.*, coalesce(k.k, 0) AS n_children FROM w LEFT JOIN k ON k.q = w.p AND k.d = w.d),
u AS (SELECT list_slice(p, 1, a) AS p, a AS d, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * words AS s FROM (SELECT *, unnest(range(d + 1)) AS a FROM y)),
s AS (SELECT p, d, sum(leaf) AS n_leaves, sum(s) AS saved FROM u GROUP BY p, d)
SELECT y.conv_id, CAST(y.d AS BIGINT) AS depth, CASE WHEN y.d > 0 THEN z.conv_id END AS parent_conv_id, y.n_convs, y.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(y.ids) AS ends_sha256
FROM y JOIN s ON s.p = y.p AND s.d = y.d LEFT JOIN n z ON z.p = y.q AND z.d = y.d - 1
"""
