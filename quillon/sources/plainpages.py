"""Nodes of pages that are written plainly, many pages at once: a table of moves turns tags into starts and ends of nodes, and
numbers, parents, cells and paths are made of those in arrays, a level at a time.

The rows are those of nodes.Tree, which reads all other pages.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.sources.nodes import AROUND, BLOCKS, CELLS, DIGITS, ENDS, GRID, KINDS, PARAGRAPH

#: A tag in small letters, its attributes quoted, with their tag's name; and the tags that are read by it. Other pages are no plain ones.
TAG = re.compile(r"""<(/[a-z][a-z0-9]*|[a-z][a-z0-9]*(?=[ >]))(?: +[a-z]+=(?:"[^"<>]*"|'[^'<>]*'))*>""")
INLINE = {"b", "i", "em", "strong", "span"}
KNOWN = {f"{end}{tag}" for tag in {*KINDS, *GRID, *INLINE} for end in ("", "/")} | {"br", "hr"}
#: Elements in each other, and stacks of open elements that a worker keeps moves of.
DEEPEST, STATES = 64, 20_000
#: What happens in a page: text, the end of a node, a row of a table, or the start of a node by its tag.
TEXT, END, ROW, FIRST = 0, 1, 2, 3
TAGS = list(KINDS)
#: By what happens.
_KIND = np.array(["text", None, None, *KINDS.values()], object)
_TAG = pa.array([None, None, None, *TAGS], pa.string())
_CELL, _TABLE = _KIND == "cell", _KIND == "table"
_KIND = pa.array(_KIND, pa.string())

#: A state is the moves from one stack: by tag (next state, what happens, whether text ends); its stack stands at None.
_states: dict[tuple, dict] = {}


def _state(stack: tuple) -> dict:
    if len(_states) > STATES:
        _states.clear()
    return _states.setdefault(stack, {None: stack})


def _learn(state: dict, tag: str):
    """The move by a tag, by the rules of Tree; None if it isn't a plain one."""
    if tag not in KNOWN:
        return None
    stack, happens = list(state[None]), bytearray()
    top = len(stack)
    if tag in ("br", "hr"):
        pass
    elif tag[0] == "/":
        tag = tag[1:]
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == tag:
                top = i
            if stack[i] == tag or stack[i] in CELLS and tag not in GRID:
                break
        tag = "/" + tag
    else:
        ends, stop = ENDS.get(tag) or ((PARAGRAPH, AROUND) if KINDS.get(tag) in BLOCKS else ((), ()))
        for i in range(len(stack) - 1, -1, -1) if ends else ():
            if stack[i] in stop:
                break
            if stack[i] in ends:
                top = i
    while len(stack) > top:
        if stack.pop() in KINDS:
            happens.append(END)
    if tag[0] != "/" and tag not in ("br", "hr"):
        if tag == "tr" and "table" in stack:
            happens.append(ROW)
        elif tag in KINDS:
            happens.append(FIRST + TAGS.index(tag))
        stack.append(tag)
    if len(stack) > DEEPEST:
        return None
    state[tag] = _state(tuple(stack)), bytes(happens), any(e != ROW for e in happens)
    return state[tag]


def happenings(page: str) -> tuple[bytearray, list[str]] | None:
    """What happens in a page, in order, and its texts; None if it isn't written plainly."""
    parts = TAG.split(page)
    if len(parts) // 2 != page.count("<"):
        return None
    if "&" in page:
        parts[::2] = [unescape(t) for t in parts[::2]]
    state, happens, texts, begun = _state(()), bytearray(), [], ""
    parts = iter(parts)
    # the text after the last tag ends the loop
    for text in parts:
        begun += text
        tag = next(parts, None)
        if tag is None:
            break
        move = state.get(tag) or _learn(state, tag)
        if move is None:
            return None
        state, after, ends = move
        if ends:
            if begun:
                if words := " ".join(begun.split()):
                    texts.append(words)
                    happens.append(TEXT)
                begun = ""
            happens += after
        elif after:
            happens += after
        elif tag in ("br", "hr"):
            begun += "\n"
    if words := " ".join(begun.split()):
        texts.append(words)
        happens.append(TEXT)
    happens += bytes([END]) * sum(t in KINDS for t in state[None])
    return happens, texts


def _runs(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted key the place where its run begins."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)


def _cells(table: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of cells, from their tables (-1: none) and rows of those, in order."""
    by = np.flatnonzero(table >= 0)
    by = by[np.argsort(table[by], kind="stable")]
    key, c = table[by], cell[by].astype(np.int64)
    start = _runs(key)
    rows, cells = np.cumsum(1 - c), np.cumsum(c) - c
    # rows of its own table so far; a cell before the first of them has begun one
    so_far = rows - (rows - (1 - c))[start]
    row, col = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    row[by] = np.where(c[start] == 1, so_far, np.maximum(so_far - 1, 0))
    begins = (c == 0) | (start == np.arange(len(by)))
    col[by] = cells - np.maximum.accumulate(np.where(begins, cells, 0)) if len(by) else 0
    return row, col


def nodes(pages: list[tuple[bytearray, list[str]]], kinds: set[str] | None, columns: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """How many nodes of these kinds each page has, and their columns, page after page."""
    code = np.frombuffer(b"".join(h for h, _ in pages), np.uint8)
    page = np.repeat(np.arange(len(pages)), [len(h) for h, _ in pages])
    opens, ends = code >= FIRST, code == END
    level = np.cumsum(opens, dtype=np.int64) - np.cumsum(ends, dtype=np.int64)
    finished = np.cumsum(ends | (code == TEXT), dtype=np.int64)
    # nodes, and rows of tables among them
    at = np.flatnonzero(~ends)
    kind, page, depth = code[at], page[at], level[at] - opens[at]
    real = kind != ROW
    up = np.full(len(at), -1)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    table, number = np.full(len(at), -1), np.zeros(len(at), np.int64)
    for d, here in enumerate(levels):
        if d:
            holders = levels[d - 1][kind[levels[d - 1]] >= FIRST]
            up[here] = holders[np.searchsorted(holders, here) - 1]
            table[here] = np.where(_TABLE[kind[up[here]]], up[here], table[up[here]])
        begin = _runs(up[here] if d else page[here])
        before = np.cumsum(real[here]) - real[here]
        number[here] = before - before[begin]
    cell = _CELL[kind]
    place = np.flatnonzero(cell | ~real)
    row, col = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    row[place], col[place] = _cells(table[place], cell[place])
    # the k-th end on a level is that of the k-th start on it
    post = finished[at] - 1
    starts, stops = np.flatnonzero(kind >= FIRST), np.flatnonzero(ends)
    post[starts[np.argsort(depth[starts], kind="stable")]] = finished[stops[np.argsort(level[stops], kind="stable")]] - 1
    grid = np.zeros(len(at), bool)
    grid[up[cell & (up >= 0)]] = True
    # rows of tables are no nodes
    index = np.cumsum(real) - 1
    keep = np.flatnonzero(real)
    kind, page, depth, post, cell, grid, row, col, up = (x[keep] for x in (kind, page, depth, post, cell, grid, row, col, up))
    up = np.where(up >= 0, index[up], -1)
    first = np.searchsorted(page, np.arange(len(pages) + 1))
    pre = np.arange(len(keep)) - first[page]
    post -= first[page]
    wanted = np.arange(len(keep)) if kinds is None else np.flatnonzero(np.isin(kind, [i for i, k in enumerate(_KIND.to_pylist()) if k in kinds]))

    def path():
        part = pc.binary_join_element_wise(pc.utf8_lpad(pa.array(number[keep]).cast(pa.string()), DIGITS, "0"), _KIND.take(pa.array(kind)), ":")
        if cell.any():
            text = lambda x: pa.array(x[cell]).cast(pa.string())
            part = pc.replace_with_mask(part, pa.array(cell), pc.binary_join_element_wise(part.filter(pa.array(cell)), "(", text(row), ",", text(col), ")", ""))
        order = np.argsort(depth, kind="stable")
        rank, done = np.empty(len(keep), np.int64), []
        for here in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            rank[here] = np.arange(len(here))
            own = part.take(pa.array(here))
            done.append(pc.binary_join_element_wise(done[-1].take(pa.array(rank[up[here]])), own, "/") if done else own)
        place = np.empty(len(keep), np.int64)
        place[order] = np.arange(len(keep))
        return pa.concat_arrays(done).take(pa.array(place[wanted]))

    def texts():
        told = pa.array([t for _, ts in pages for t in ts], pa.string())
        is_text = kind == TEXT
        return told.take(pa.array((np.cumsum(is_text) - 1)[wanted], pa.int64(), mask=~is_text[wanted]))

    number_of = lambda x, null=None: pa.array(x[wanted], pa.int32(), mask=None if null is None else null[wanted])
    made = {
        "pre": lambda: number_of(pre),
        "post": lambda: number_of(post),
        "depth": lambda: number_of(depth),
        "parent": lambda: number_of(np.where(up >= 0, pre[up], 0), up < 0),
        "kind": lambda: _KIND.take(pa.array(kind[wanted])),
        "tag": lambda: _TAG.take(pa.array(kind[wanted])),
        "path": path,
        "row": lambda: number_of(row, ~cell),
        "col": lambda: number_of(col, ~cell),
        "text": texts,
        "grid": lambda: pa.array(grid[wanted]),
    }
    return np.bincount(page[wanted], minlength=len(pages)), [made[c]() for c in columns]
