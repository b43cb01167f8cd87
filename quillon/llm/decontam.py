"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK random walk copies a string into one three times as long, staying on a character or
stepping on as random bits for each place and character say; strings a few edits apart fall back
into step, so edit distance becomes Hamming distance. Windows of an item's size are embedded
several times with different bits, a few places of each embedding make a bucket key, and a window
that shares a key with its item is verified by the exact edit distance.

Windows are laid at anchors, stretches that a text and an item share: bytes in a row, whatever the
words are, where enough of them stand about as far apart in both; and three words in a row, or two
or one long enough. Both strings are embedded from the anchor on, so they start in step.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkernel as K
from quillon.llm.runtime import materialize, session, steps, table, text_parts, turn_to

#: Bytes in a row of an anchor; how far shifts of anchors of one passage may differ (a power of two); and
#: bytes of an item for which one anchor is asked for, of at least two (one in short items) and MOST at most.
GRAM, BAND, EVERY, SHORT, MOST = 8, 32, 20, 40, 12
#: Words in a row that are an anchor by themselves, and the fewest bytes they must span.
SEEDS = ((3, 0), (2, 9), (1, 14))
#: Embeddings, bucket keys of each, and places in a key: two strings whose embeddings agree in a
#: share p of their places meet with probability 1 - (1 - p**PLACES)**(WALKS * KEYS).
WALKS, KEYS, PLACES = 6, 64, 4
#: Share of an embedding that is sampled: a walk uses its string up after about two thirds.
REACH = 0.6
#: Bytes of benchmark text that are told to the executors at once; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
_SEED_BITS = 22
#: Bytes of embeddings that stand in memory at once, of a text and stretches that one step works on, and bits of the sums that anchors are first counted in.
WALKED, SLICE, STRETCHES, _COUNT_BITS = 4 << 20, 1 << 16, 1 << 18, 18


def squeeze(text: str | None) -> str:
    """Lower-cased (A-Z) words with single spaces between them."""
    return b" ".join(bytes(K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]).split()).decode()


@functools.lru_cache(maxsize=8)
def _random(steps_: int) -> np.ndarray:
    """Fixed pseudo-random bits by step, walk and byte; more steps go on from fewer."""
    with np.errstate(over="ignore"):
        x = np.arange(WALKS, dtype=np.uint64)[None, :, None] * np.uint64(1 << 40) + np.arange(steps_, dtype=np.uint64)[:, None, None] * np.uint64(1 << 8) + np.arange(256, dtype=np.uint64)
        return (K.mix(x + np.uint64(K.MULT)) >> np.uint64(17)).astype(np.uint8) & 1


def embed(strings: np.ndarray, lengths: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Bucket keys (rows x WALKS * KEYS) of byte strings in rows, padded with zeros: a key is the bytes at its places, which
    says as much as a hash of them. Rows of a length should stand together."""
    n, width = len(strings), max(strings.shape[1], int(lengths.max(initial=0)))
    steps_ = int(3 * width * REACH) + 1
    bits = _random(-(-steps_ // 256) * 256).reshape(-1, WALKS * 256)
    padded = np.zeros((n, width + 1), np.uint8)
    padded[:, : strings.shape[1]] = strings
    wanted = np.stack(places).reshape(WALKS, -1)  # as shares of the embedding
    walk = np.arange(WALKS)[:, None]
    out = np.zeros((n, WALKS * KEYS), np.uint32)
    many = max(1, WALKED // (steps_ * WALKS))
    for a in range(0, n, many):
        part, size = padded[a : a + many].ravel(), lengths[a : a + many]
        m = len(size)
        at = np.tile(np.arange(m) * (width + 1), WALKS)
        end = at + np.tile(size, WALKS)
        own = np.repeat(np.arange(WALKS) * 256, m)
        seen = np.empty((steps_, WALKS * m), np.uint8)
        for j in range(steps_):
            c = part.take(at)
            seen[j] = c
            at += bits[j].take(own + c)
            np.minimum(at, end, out=at)
        seen = seen.reshape(steps_, WALKS, m)
        cut = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1], [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            # each string's own embedding is three times its length, so shares meet for strings of near lengths
            got = seen[(wanted * (3 * int(size[lo]))).astype(np.int64), walk, lo:hi].reshape(WALKS * KEYS, PLACES, hi - lo)
            key = np.zeros((WALKS * KEYS, hi - lo), np.uint32)
            for p in range(PLACES):
                key = key << np.uint32(8) | got[:, p]
            out[a + lo : a + hi] = key.T
    return out


def sample_places() -> list[np.ndarray]:
    rng = np.random.RandomState(20260101)
    return [rng.random_sample((KEYS, PLACES)) * REACH for _ in range(WALKS)]


def _tables(items: list[bytes], words: int) -> np.ndarray:
    """For each item, byte and 64-bit word: at which of the word's places of the item the byte stands."""
    out = np.zeros((len(items), 256, words), np.uint64)
    for i, t in enumerate(items):
        at = np.arange(len(t))
        np.bitwise_or.at(out, (i, np.frombuffer(t, np.uint8), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def best_places(items: list[bytes], own: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of items[own[k]] to any stretch of texts[k], end of the first such stretch) for all
    k: Myers' bit vectors in words of 64 bits, one step of all texts at a time. Items are not empty."""
    sizes = np.array([len(t) for t in items], np.int64)
    best, end = sizes[own].copy(), np.zeros(len(own), np.int64)
    blocks = -(-sizes[own] // 64)
    one, top = np.uint64(1), np.uint64(63)
    blocks += blocks & 1  # fewer and larger groups
    for words in np.unique(blocks).tolist():
        rows = np.flatnonzero(blocks == words)
        rows = rows[np.argsort([-len(texts[k]) for k in rows], kind="stable")]  # those that end first stand last
        mine, at = np.unique(own[rows], return_inverse=True)
        table = _tables([items[i] for i in mine], words)
        n = np.array([len(texts[k]) for k in rows])
        wide = np.zeros((int(n.max(initial=0)), len(rows)), np.uint8)
        for r, k in enumerate(rows):
            wide[: len(texts[k]), r] = np.frombuffer(texts[k], np.uint8)
        pv = [np.full(len(rows), ~np.uint64(0)) for _ in range(words)]
        mv = [np.zeros(len(rows), np.uint64) for _ in range(words)]
        last = ((sizes[own[rows]] - 1) & 63).astype(np.uint64)
        at_word = [np.flatnonzero((sizes[own[rows]] - 1) >> 6 == w) for w in range(words)]
        score = sizes[own[rows]].copy()
        low, where = score.copy(), np.zeros(len(rows), np.int64)
        left = np.searchsorted(-n, -np.arange(len(wide)), "left")  # texts longer than j
        for j, m in enumerate(left.tolist()):
            eqs = table[at[:m], wide[j, :m]]
            plus = minus = np.zeros(m, np.uint64)  # what the word before hands on
            for w in range(words):
                eq, p, q = eqs[:, w], pv[w][:m], mv[w][:m]
                xv = eq | q
                eq = eq | minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                ends = at_word[w][: np.searchsorted(at_word[w], m)]  # items whose last byte stands in this word
                if len(ends):
                    score[ends] += (ph[ends] >> last[ends] & one).astype(np.int64) - (mh[ends] >> last[ends] & one).astype(np.int64)
                up, down = ph >> top, mh >> top
                ph, mh = ph << one | plus, mh << one | minus
                plus, minus = up, down
                pv[w][:m], mv[w][:m] = mh | ~(xv | ph), ph & xv
            better = np.flatnonzero(score[:m] < low[:m])
            low[better], where[better] = score[better], j + 1
        best[rows], end[rows] = low, where
    return best, end


def best_place(item: bytes, text: bytes) -> tuple[int, int]:
    """best_places() of one."""
    got = best_places([item], np.zeros(1, np.int64), [text])
    return int(got[0][0]), int(got[1][0])


class Items:
    """A block of benchmark items: bytes, and their anchors by hash."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.bytes = ids, [squeeze(t).encode() for t in texts]
        keys, refs, grams, at = [], [], [], []
        self.places, self.profiles = sample_places(), {}
        for i, t in enumerate(self.bytes):
            buf = np.frombuffer(t, np.uint8)
            g = _grams(buf)
            grams.append(g)
            at.append(np.stack([np.full(len(g), i), np.arange(len(g))], 1))
            s, e, f = K.word_spans(buf, np.array([0, len(buf)]))
            if not len(s):
                continue
            words = K.word_hashes(buf, s, e)
            for k, span in SEEDS:
                h, _ = K.shingles(words, f, k, short=False)
                for w in np.flatnonzero(e[k - 1 :] - s[: len(s) - k + 1] >= span) if len(h) else ():
                    keys.append(h[w])
                    refs.append((i, s[w]))
        self.words = _Index(np.array(keys, np.uint64), np.array(refs, np.int64).reshape(-1, 2))
        self.grams = _Index(np.concatenate([np.zeros(0, np.uint64), *grams]), np.concatenate([np.zeros((0, 2), np.int64), *at]))
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.least = np.clip((self.lengths - GRAM + 1) // EVERY, np.where(self.lengths < SHORT, 1, 2), MOST)


    def profile(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """By the code of three bytes in a row the place (from 1) of what the item has, and how often it has that."""
        if i not in self.profiles:
            if len(self.profiles) >= 1024:
                self.profiles.clear()
            have, many = np.unique(_codes(np.frombuffer(self.bytes[i], np.uint8)), return_counts=True)
            slots = np.zeros(4096, np.int32)
            slots[have] = np.arange(1, len(have) + 1)
            self.profiles[i] = slots, many
        return self.profiles[i]


def _codes(buf: np.ndarray) -> np.ndarray:
    """Each three bytes in a row, by hash."""
    x = buf.astype(np.int32)
    return (x[:-2] * 961 + x[1:-1] * 31 + x[2:]) & 4095


def _shared(codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, own: np.ndarray, items: Items) -> np.ndarray:
    """How many runs of three bytes (or more: they are counted by hash) each stretch has of its item's."""
    out = np.zeros(len(own), np.int64)
    size = np.maximum(stop - begin - 2, 0)
    order = np.argsort(own, kind="stable")
    step = (np.cumsum(size[order]) // STRETCHES) * len(order) + np.arange(len(order)) // 256
    cut = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True])))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        rows = order[lo:hi]
        some, which = np.unique(own[rows], return_inverse=True)
        profiles = [items.profile(i) for i in some.tolist()]
        most = max(len(many) for _, many in profiles) + 1
        slots, limit = np.stack([p for p, _ in profiles]), np.zeros((len(some), most), np.int64)
        for k, (_, many) in enumerate(profiles):
            limit[k, 1 : len(many) + 1] = many
        n = size[rows]
        place = np.arange(int(n.sum())) + np.repeat(begin[rows] - np.cumsum(n) + n, n)
        slot = slots.ravel().take(codes.take(place) + np.repeat(which * 4096, n))
        have = np.bincount(slot + np.repeat(np.arange(len(rows)) * most, n), minlength=len(rows) * most).reshape(-1, most)
        out[rows] = np.minimum(have, limit[which]).sum(1)
    return out


def _grams(buf: np.ndarray) -> np.ndarray:
    """Each GRAM bytes in a row, mixed."""
    x, have = buf.astype(np.uint64), 1
    while have < GRAM:
        k = min(have, GRAM - have)  # bytes that both sides hold are the same bits
        x = x[:-k] << np.uint64(8 * k) | x[k:] if len(x) > k else x[:0]
        have += k
    return K.mix(x)


class _Index:
    """(item, place) by hash."""

    def __init__(self, keys: np.ndarray, refs: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.refs = refs[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(keys)))
        self.bits = np.zeros(1 << _SEED_BITS, bool)
        self.bits[(self.keys & np.uint64((1 << _SEED_BITS) - 1)).astype(np.int64)] = True
        # hashes are even, so about one key begins with the same bits
        self.top = np.uint64(64 - max(8, len(self.keys).bit_length()))
        self.begin = np.searchsorted(self.keys >> self.top, np.arange(1 << (64 - int(self.top)), dtype=np.uint64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, refs) of all agreements."""
        maybe = np.flatnonzero(self.bits.take((h & np.uint64((1 << _SEED_BITS) - 1)).view(np.int64)))
        if not len(maybe):
            return maybe, np.zeros((0, 2), np.int64)
        h = h[maybe]
        k = self.begin.take((h >> self.top).view(np.int64))
        last = len(self.keys) - 1
        np.minimum(k, last, out=k)
        behind = np.flatnonzero((self.keys.take(k) < h) & (k < last))
        while len(behind):
            k[behind] += 1
            at = k[behind]
            behind = behind[(self.keys[at] < h[behind]) & (at < last)]
        same = self.keys.take(k) == h
        maybe, k = maybe[same], k[same]
        many = self.many[k]
        begin = np.repeat(self.first[k] - np.cumsum(many) + many, many)
        return np.repeat(maybe, many), self.refs.take(begin + np.arange(len(begin)), axis=0)


def _crowded(key: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which hits may stand in two neighbouring bands with least hits or more: counted by hash, so never too few."""
    mask = (1 << _COUNT_BITS) - 1
    at = ((key >> 32) * 0x9E3779B1 + (key & 0xFFFFFFFF)) & mask
    have = np.bincount(at, minlength=mask + 1)
    return have.take(at) + np.maximum(have.take((at + 1) & mask), have.take((at - 1) & mask)) >= least


def _anchors(doc: np.ndarray, place: np.ndarray, ref: np.ndarray, items: Items) -> np.ndarray:
    """Rows of text, item, place in the text and place in the item: up to three for each item and band of shifts with enough
    shared bytes, the first in the item and those past a quarter and a half of it (ties: the last in the text)."""
    shift = place - ref[:, 1] + (int(items.lengths.max()) // BAND + 2) * BAND
    key = (doc * len(items.ids) + ref[:, 0]) << 32 | shift // BAND
    some = np.flatnonzero(_crowded(key, items.least.take(ref[:, 0])))
    key, at = key[some], ref[some, 1]
    order = np.lexsort((-place[some], at, key))
    some, key, at = some[order], key[order], at[order]
    if not len(some):
        return np.zeros((0, 4), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cut, len(key)))
    band = key[cut]
    after = np.append(band[1:] == band[:-1] + 1, False)
    before = np.concatenate(([False], after[:-1]))
    # bands overlap by half: a run with the next one, and one that has none before it alone
    low = np.concatenate([np.arange(len(cut)), np.flatnonzero(~before)])
    high = np.concatenate([np.arange(len(cut)) + after, np.flatnonzero(~before)])
    many = np.where(low == high, size[low], size[low] + size[high])
    own = (band[low] >> 32) % len(items.ids)
    enough = many >= items.least[own]
    low, high, length = low[enough], high[enough], items.lengths[own[enough]]
    run = np.repeat(np.arange(len(cut)), size) << 32 | at
    found = []
    for least in (np.zeros(len(low), np.int64), length // 4, length // 2):
        a, b = (np.searchsorted(run, r << 32 | least) for r in (low, high))
        has_a, has_b = a < cut[low] + size[low], b < cut[high] + size[high]
        a, b = np.minimum(a, len(at) - 1), np.minimum(b, len(at) - 1)
        use = has_a & (~has_b | (at[a] < at[b]))
        found.append(np.where(use, a, b)[has_a | has_b])
    hits = some[np.unique(np.concatenate(found))]
    return np.stack([doc[hits], ref[hits, 0], place[hits], ref[hits, 1]], 1)


def _windows(col: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(row, item, first word, place in the stretch, place in the item, squeezed stretch of text) of each anchor."""
    if not len(items.ids) or not items.lengths.max():
        return
    for lo, hi in steps(col):
        buf, offsets = text_parts(col.slice(lo, hi - lo))
        if not len(buf):
            continue
        space = K.SPACE[buf]
        keep = ~space
        keep[1:] |= ~space[:-1]
        buf = np.where(space, np.uint8(32), K.LOWER[buf])[keep]
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        starts, ends, first = K.word_spans(buf, offsets)
        found = []
        for s in range(0, len(buf) - GRAM + 1, SLICE):
            pos, ref = items.grams.find(_grams(buf[s : s + SLICE + GRAM - 1]))
            found.append((pos + s, ref))
        pos, ref = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros((0, 2), np.int64)), *found, strict=True))
        doc = np.searchsorted(offsets, pos, "right") - 1
        within = pos + GRAM <= offsets[doc + 1]
        pos, ref, doc = pos[within], ref[within], doc[within]
        found = [_anchors(doc, pos - offsets[doc], ref, items)] if len(pos) else []
        words = K.word_hashes(buf, starts, ends)
        for k, _ in SEEDS:
            h, sf = K.shingles(words, first, k, short=False)
            hit, ref = items.words.find(h)
            if len(hit):
                doc = np.searchsorted(sf, hit, "right") - 1
                at = starts[first[doc] + hit - sf[doc]] - offsets[doc]
                # one for each start of a window
                order = np.lexsort((at - ref[:, 1], ref[:, 0], doc))
                rows = np.stack([doc, ref[:, 0], at, ref[:, 1]], 1)[order]
                start = np.stack([rows[:, 0], rows[:, 1], rows[:, 2] - rows[:, 3]])
                found.append(rows[np.concatenate(([True], (start[:, 1:] != start[:, :-1]).any(0)))])
        if not any(map(len, found)):
            continue
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        d, i, p, q = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))].T
        size = items.lengths[i]
        slack = size // 5
        a = offsets[d]
        begin, stop = np.maximum(a, a + p - q - slack), np.minimum(offsets[d + 1], a + p - q + size + slack)
        # an edit spoils three of the item's runs of three bytes at most; the others stand in the stretch
        order = np.lexsort((p - q, i, d))
        one = np.concatenate(([True], (np.diff(np.stack([d, i, p - q])[:, order]) != 0).any(0)))
        have = np.zeros(len(d), np.int64)
        have[order] = _shared(_codes(buf), *(x[order[one]] for x in (begin, stop, i)), items)[np.cumsum(one) - 1]
        left = np.flatnonzero(have >= size - 2 - 3 * slack)
        w = np.maximum(np.searchsorted(starts, np.maximum(a, a + p - q)[left], "right") - 1 - first[d[left]], 0)
        for x in zip((lo + d[left]).tolist(), i[left].tolist(), w.tolist(), (a + p - begin)[left].tolist(), q[left].tolist(), begin[left].tolist(), stop[left].tolist(), strict=True):
            yield *x[:5], bytes(buf[x[5] : x[6]])


def _match(items_b, percent: int, embed_rows: int = 16384):
    def run(batches):
        turn_to("decontam")
        items = items_b.value
        ids: list = []
        held: list[tuple[int, int, int, int, int, bytes]] = []

        def flush(kind):
            found: dict[tuple[int, int], tuple[int, int]] = {}
            near: list[tuple[int, int, int, int, int, bytes]] = []
            held.sort(key=lambda x: (int(items.lengths[x[1]]) - x[4], x[1], x[4]))  # strings of a length are embedded together, items once
            for a in range(0, len(held), 1024):
                part = held[a : a + 1024]
                sizes, own, strings = [], [], []
                for _, i, _, p, q, t in part:
                    n = int(items.lengths[i]) - q
                    if not own or (i, q) != part[len(own) - 1][1:5:3]:
                        item = len(strings)
                        strings.append(items.bytes[i][q:])
                        sizes.append(n)
                    own.append(item)
                    strings.append(t[p : p + n])
                    sizes.append(n)
                rows = np.zeros((len(strings), max(1, *sizes)), np.uint8)
                for r, t in enumerate(strings):
                    rows[r, : len(t)] = np.frombuffer(t, np.uint8)
                keys = embed(rows, np.array(sizes, np.int64), items.places)
                texts = np.ones(len(strings), bool)
                texts[own] = False
                meet = (keys[texts] == keys[own]).any(1)
                near += [x for x, ok in zip(part, meet.tolist(), strict=True) if ok]
            some, which = np.unique(np.array([i for _, i, *_ in near], np.int64), return_inverse=True)
            dist, _ = best_places([items.bytes[i] for i in some], which, [t for *_, t in near])
            for (d, i, w, *_), e in zip(near, dist.tolist(), strict=True):
                if e <= (100 - percent) * int(items.lengths[i]) // 100:
                    found[(d, i)] = min(found.get((d, i), (e, w)), (e, w))
            keys = sorted(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in keys], kind), pa.array([items.ids[i] for _, i in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([1 - found[k][0] / max(1, int(items.lengths[k[1]])) for k in keys], pa.float64())],
                ["doc_id", "item_id", "first_word", "distance", "similarity"],
            )

        kind = None
        for b in batches:
            kind = b.column(0).type
            rows: dict[int, int] = {}
            for d, *rest in _windows(b.column(1), items):
                if d not in rows:
                    rows[d] = len(ids)
                    ids.append(b.column(0)[d].as_py())
                held.append((rows[d], *rest))
            if len(held) >= embed_rows:
                yield flush(kind)
                held.clear()
                ids.clear()
        if held:
            yield flush(kind)

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """(id_col, item_id, first_word, distance, similarity): texts that hold an item, or a stretch
    whose edit distance to it is at most 1 - percent / 100 of its length; case (A-Z) and white
    space don't count. One row per row of docs and item, with the closest stretch (ties: the
    first); first_word is the word where its window starts.

    Items of fewer than three words and under GRAM bytes and null items match nothing; null and empty texts match
    nothing; equal items each match; repeated rows and null ids are kept; empty tables give no
    rows; other columns are ignored. Long texts are read whole, in steps. Items are read in blocks of bounded size, so a
    benchmark of any size takes more passes over docs, not more memory.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    bench = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else bench
        rows = part.orderBy("i", "t").collect()
        held = spark.sparkContext.broadcast(Items([r["i"] for r in rows], [r["t"] for r in rows]))
        got = texts.mapInArrow(_match(held, percent), f"doc_id {kind}, item_id long, first_word long, distance long, similarity double")
        if blocks > 1:  # one block at a time stands in memory, here and on the executors
            got = materialize(got, "decontam-block")
            held.unpersist()
        out = got if out is None else out.union(got)
    return out.withColumnRenamed("doc_id", id_col)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
