"""Main text of web pages by maximum-scoring subsequence.

A page becomes a row of tokens: words score positive, tags negative, and words inside menus,
adverts, forms and the like about nothing. One linear scan (Kadane's) finds the contiguous region
with the highest sum. Weights are log-odds from labelled pages - those that mark their own article:
a tag that stands mostly outside articles costs more, a word in a link less, and words in class and id
attributes tell whether an element is part of an article.

The region decides where the text starts and ends. It is widened to whole blocks, and to the ends of
the article elements it has words of; its text leaves out the elements that don't belong to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import session, table

#: Labelled pages that weights are learnt from, at most, and their longest; they are the first by a
#: hash of their address.
SAMPLE, LONGEST = 256, 100_000

#: Elements whose content is never text, and those that hold no article text.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp noembed noframes".split())
ASIDE = RAW | frozenset("head nav header footer aside form menu dialog button select option datalist fieldset legend label audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | ASIDE - frozenset(("button", "label", "select", "option", "map"))
MAIN = frozenset(("article", "main"))
#: Words in class, id or role of what surrounds an article, and of what holds one: log-odds before any page is seen.
#: Words that say that something else is there, or isn't, take what follows them out of account.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adslot adbox sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion widget widgets login search toolbar contentinfo complementary form dialog alert outbrain taboola paywall".split())
HOLDERS, WEAK = frozenset("article articles post story entry main".split()), frozenset("content body text page wrapper container".split())
ASIDE_ODDS, HOLDER_ODDS, WEAK_ODDS, CLASS_BOUNDS = -1.1, 1.1, 0.5, (-2.0, 1.1)
POINTERS = frozenset("has with no without show hide is".split())
#: Elements whose end tags may be left out, with the elements that an open one is looked for through: any but those.
OPTIONAL = {"p": None, "li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}
#: Share of a page's words above which an element that only its class speaks against, or a form, holds the page
#: itself, if all headings and articles stand in it too.
HOLDS = 0.6
#: Words of a text that is taken for an article though classes speak against it, if there is no other.
LONG = 50
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Bounds of learnt weights: no tag is worth a word, no aside is worth crossing for long.
WORD, LINK, TAG_LEAST, TAG_MOST, ASIDE_WORD = (0.5, 2.0), (0.1, 0.6), -0.3, -0.05, -0.02


def _names(attrs: str) -> tuple[set[tuple[str, int]], bool]:
    """((word, weight) of class, id and role; whether the attributes hide the element). The last word of a name
    says what it is, and weighs twice."""
    out: set[tuple[str, int]] = set()
    if not attrs or attrs.isspace():
        return out, False
    low = attrs.lower()
    gone = "hidden" in low and re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", low)) is not None
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id", "role"):
            for name in value.split():
                words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
                cut = next((i for i, w in enumerate(words) if w in POINTERS), len(words))
                out.update((w, 1 + (i == len(words) - 1)) for i, w in enumerate(words[:cut]))
        elif key == "style" and _HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            gone = True
    return out, gone


def class_odds(word: str, weights: dict[str, float]) -> float:
    known = weights.get(f"class:{word}")
    return known if known is not None else ASIDE_ODDS if word in MARKS else HOLDER_ODDS if word in HOLDERS else WEAK_ODDS if word in WEAK else 0.0


def lexed(page: str) -> list[tuple[str, str, str]]:
    """(kind, value, attributes) in order: kind 't' text, '<' an opening, '/' a closing and '.' an empty tag. Text is
    still encoded; comments, declarations and raw elements' contents are left out."""
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            out.append(("t", page[at:], ""))
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] in ("/", "!", "?") and lt + 2 < n:
                if lt > at:
                    out.append(("t", page[at:lt], ""))
                break  # a tag that never ends
            end = page.find("<", lt + 1)
            end = n if end < 0 else end
            out.append(("t", page[at:end], ""))
            at = end
            continue
        if lt > at:
            out.append(("t", page[at:lt], ""))
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            out.append(("/", name, ""))
            continue
        attrs = m.group(3) or m.group(6) or ""
        empty = name in VOID or name in RAW and attrs.rstrip().endswith("/")
        out.append(("." if empty else "<", name, attrs))
        if name in RAW and not empty:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else n
    return out


def element_ends(toks: list[tuple[str, str, str]]) -> tuple[list[int], list[bool]]:
    """For each opening tag where its element ends, and whether a tag says so: its own end tag or, where that may
    be left out, the start of a like element or the end of what holds it. Linear: what could be closed is
    known at each open element."""
    n = len(toks)
    ends, said = [n] * n, [True] * n
    stack: list[int] = []
    reach: list[dict[str, int]] = []  # by name, the open element that a like one would close
    open_ = Counter()

    def close(i: int, own: bool) -> None:
        j = stack.pop()
        reach.pop()
        name = toks[j][1]
        open_[name] -= 1
        ends[j], said[j] = i, own or name in OPTIONAL

    for i, (kind, name, _) in enumerate(toks):
        if kind == "<":
            like = ("td", "th") if name in ("td", "th") else ("dd", "dt") if name in ("dd", "dt") else (name,) if name in OPTIONAL else ()
            if name in BLOCKS:
                like += ("p",)
            while stack and (found := [reach[-1][x] for x in like if x in reach[-1]]):
                to = max(found)
                while stack and stack[-1] >= to:
                    close(i, False)
            up = reach[-1] if reach else {}
            here = {k: v for k, v in up.items() if (name not in BLOCKS if k == "p" else name not in OPTIONAL[k] and (name not in BLOCKS or name in ("div", "p", "address") or k in ("td", "th", "tr", "option")))} if up and name in BLOCKS or name == "select" else up
            if name in OPTIONAL:
                here = here | {name: i}
            stack.append(i)
            reach.append(here)
            open_[name] += 1
        elif kind == "/" and open_[name]:
            while toks[stack[-1]][1] != name:
                close(i, False)
            close(i, True)
    for j in stack:
        said[j] = toks[j][1] in OPTIONAL
    return ends, said


def tokens(page: str, weights: dict[str, float] = {}, classes: bool = True) -> list[tuple[str, str, bool]]:  # noqa: B006
    """(kind, value, aside): the page's tokens, and whether they stand in an element that is no article text. Such an
    element reaches to its end or, if nothing says where that is, to where an article may start. Without classes,
    tags alone speak against an element."""
    toks = lexed(page)
    n = len(toks)
    ends, said = element_ends(toks)
    start = [n] * (n + 1)  # the next place where an article may start
    for i in range(n - 1, -1, -1):
        start[i] = i if toks[i][0] == "<" and (toks[i][1] in MAIN or toks[i][1] in ("h1", "body")) else start[i + 1]
    heads = list(accumulate((k == "<" and (v in MAIN or v == "h1") for k, v, _ in toks), initial=0))
    aside = [0] * (n + 1)
    soft: list[tuple[int, int]] = []
    for i, (kind, name, attrs) in enumerate(toks):
        if kind != "<" or name in ("html", "body"):
            continue
        words, gone = _names(attrs)
        hard = gone or name in ASIDE and name != "form"
        odds = sum(k * class_odds(w, weights) for w, k in words) + HOLDER_ODDS * 2 * (name in MAIN)
        if hard or name == "form" or odds < 0:
            end = ends[i] if said[i] else min(ends[i], max(i + 1, start[i + 1]))
            if hard:
                aside[i] += 1
                aside[end] -= 1
            else:
                soft.append((i, end))
    covered = list(accumulate(aside))
    size = list(accumulate((len(v.split()) if k == "t" and not covered[i] else 0 for i, (k, v, _) in enumerate(toks)), initial=0))
    for i, end in soft if classes else ():
        inside = size[end] - size[i]
        talk = any(w in ("comment", "comments", "commentlist", "disqus", "respond", "replies", "discussion") and k == 2 for w, k in _names(toks[i][2])[0])
        if not talk and inside > HOLDS * size[n] and heads[end] - heads[i] == heads[n] and (heads[n] or toks[i][1] == "form"):
            continue  # it holds the page itself
        aside[i] += 1
        aside[end] -= 1
    return [("<" if k == "." else k, v, f > 0) for (k, v, _), f in zip(toks, accumulate(aside), strict=False)]


def _features(toks) -> list[tuple[str, int]]:
    """(feature, words) of each token; a tag counts one."""
    out, links = [], 0
    for kind, value, aside in toks:
        if kind == "t":
            out.append(("aside" if aside else "link" if links > 0 else "word", len(value.split())))
        else:
            if value == "a":
                links = max(0, links + (1 if kind == "<" else -1))
            out.append((value, 1))
    return out


def _inside(toks) -> list[bool] | None:
    """Which tokens stand in the page's own article; None if it marks none."""
    out, depth, any_ = [], 0, False
    for kind, value, aside in toks:
        if value in MAIN and kind != "t" and not aside:
            depth = max(0, depth + (1 if kind == "<" else -1))
            any_ = True
        out.append(depth > 0)
    return out if any_ and any(out) else None


def learn(pages: list[str]) -> dict[str, float]:
    """Weights of words ('word', 'link', 'aside'), tags by name and words in classes ('class:...'), from pages that
    mark their article. Elements that hold the article tell nothing of their class."""
    inside, outside = Counter(), Counter()
    for p in pages:
        toks = tokens(p)
        marks = _inside(toks)
        if marks is None:
            continue
        for (f, n), m in zip(_features(toks), marks, strict=True):
            (inside if m else outside)[f] += n
        raw = lexed(p)
        ends, _ = element_ends(raw)
        before = list(accumulate(marks, initial=0))
        for i, (kind, name, attrs) in enumerate(raw):
            if kind == "<" and name not in MAIN and (marks[i] or before[ends[i]] == before[i]):
                (inside if marks[i] else outside).update({f"class:{w}" for w, k in _names(attrs)[0] if k == 2})
    prior = lambda f: class_odds(f[6:], {}) if f.startswith("class:") else 0.0
    odds = lambda f: float(np.log((inside[f] + 1) / (outside[f] + 1)))
    out = {}
    for f in {*inside, *outside} - {"word", "link", "aside"}:
        if f.startswith("class:"):
            if inside[f] + outside[f] >= 5:  # fewer elements say less than the word itself
                out[f] = float(np.clip((odds(f) + prior(f)) / (1 + (prior(f) != 0)), *CLASS_BOUNDS))
        else:
            out[f] = float(np.clip(odds(f), TAG_LEAST, TAG_MOST))
    return out | {"word": float(np.clip(odds("word"), *WORD)), "link": float(np.clip(odds("link"), *LINK)), "aside": ASIDE_WORD}


def value(tok, feature: str, n: int, weights: dict[str, float]) -> float:
    """What a token adds to a region."""
    tag = tok[0] != "t"
    return weights.get(feature, TAG_LEAST if tag else 0.0) * n * (0.1 if tok[2] and tag else 1)


def region(toks, weights: dict[str, float]) -> tuple[int, int]:
    """The tokens [lo, hi) with the highest sum; the first and longest of equals; empty if none is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, (f, n) in enumerate(_features(toks)):
        if total <= 0:
            total, start = 0.0, i
        # what is inside an aside goes anyway: its tags hardly part what stands before and after it
        total += value(toks[i], f, n, weights)
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def _widened(toks, lo: int, hi: int) -> tuple[int, int]:
    """The region out to whole blocks and to the ends of every article element that it has words of."""
    stack, spans = [], []
    for i, (kind, value, aside) in enumerate(toks):
        if value == "article" and kind != "t" and not aside:
            if kind == "<":
                stack.append(i)
            elif stack:
                spans.append((stack.pop(), i + 1))
    spans += [(i, len(toks)) for i in stack]
    words = list(accumulate((k == "t" and not f and not v.isspace() for k, v, f in toks), initial=0))
    touched = [(a, z) for a, z in spans if max(a, lo) < min(z, hi) and words[min(z, hi)] > words[max(a, lo)]]
    lo, hi = min([lo, *(a for a, _ in touched)]), max([hi, *(z for _, z in touched)])
    is_edge = lambda t: t[0] != "t" and t[1] in BLOCKS
    while lo > 0 and not is_edge(toks[lo - 1]):
        lo -= 1
    while hi < len(toks) and not is_edge(toks[hi]):
        hi += 1
    return lo, hi


def extract(page: str, weights: dict[str, float]) -> str:
    toks = tokens(page, weights)
    lo, hi = region(toks, weights)
    if lo >= hi:  # all text stands in what its class speaks against: a long one is taken all the same
        toks = tokens(page, weights, classes=False)
        lo, hi = region(toks, weights)
        if sum(len(v.split()) for k, v, f in toks[lo:hi] if k == "t" and not f) < LONG:
            return ""
    lo, hi = _widened(toks, lo, hi)
    blocks: list[list[str]] = [[]]
    for kind, value, aside in toks[lo:hi]:
        if kind != "t":
            if value in BLOCKS or aside:
                blocks.append([])
            elif value == "br":
                blocks[-1].append(" ")
        elif not aside:
            blocks[-1].append(value)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def _run(weights):
    def run(batches):
        for b in batches:
            texts = [extract(p or "", weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """id_col, url_col, text, n_chars for each row of pages.

    Null and empty pages, and pages without words outside menus and the like, give an empty text. Of regions with
    equal sums the first is taken. Pages are read whole in linear time, whatever their length and nesting.
    Without labelled pages the weights are their bounds' defaults. Repeated rows and null ids are
    kept; an empty table gives no rows; other columns are ignored. 'br' counts as white space.
    """
    session(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    if weights is None:
        short = rows.filter(F.length("html") <= LONGEST)
        labelled = short.filter(F.col("html").ilike("%<article%") | F.col("html").ilike("%<main%")).select("page_id", F.xxhash64("url", "page_id").alias("h")).orderBy("h").limit(SAMPLE)
        found = short.join(F.broadcast(labelled), "page_id", "left_semi").orderBy(F.xxhash64("url", "page_id"), F.xxhash64("html")).select("html").limit(SAMPLE).collect()
        weights = learn([r["html"] for r in found])
    a, b = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    return rows.mapInArrow(_run(weights), f"page_id {a}, url {b}, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
