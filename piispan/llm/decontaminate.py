"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Words of a document and of a benchmark item that share a seed (a window of `min_match` words, found
by hash) are tiled: windows of the current search length over words not yet marked are matched
by rolling hash, matches are grown, the longest that don't overlap are marked first, and the search
length falls until `min_match`. A document is contaminated by an item whose words are tiled to
`threshold` or more; tiles may come in any order, so a reordered passage counts.

Words: lower case, ASCII punctuation as white space. The benchmark is the query set: it is
read in blocks of at most `block_bytes` of text (a block is broadcast, so that is the bound of the
broadcast), each against all documents.

A match that repeats is taken where it can't grow to the left, and all matches of a length grow together, so texts of few
different words cost no more Python steps than others.

Defined results: items and documents that are null, empty, or shorter than `min_match` words match nothing;
items or documents that repeat give a row each; ties between tiles go to the first place in the item, then in the document;
null ids are carried, ids are of any type; extra columns are ignored;
an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from piispan.llm import words as W
from piispan.llm.common import narrow, sliced, text_bytes

MIN_MATCH, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20
_PUNCTUATION = {i: " " for i in range(33, 127) if not chr(i).isalnum()}
_TEXT_BYTES = 2 << 20


def normal(text: str | None) -> bytes:
    return (text or "").lower().translate(_PUNCTUATION).encode()


def _free_windows(h: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the windows of s unmarked words, and where each starts."""
    k, at = W.windows(h, np.array([0, len(h)]), s)
    taken = np.concatenate(([0], np.cumsum(~free)))
    open_ = taken[at + s] == taken[at]
    order = np.argsort(k[open_], kind="stable")
    return k[open_][order], at[open_][order]


def _maximal(item: np.ndarray, doc: np.ndarray, a_free: np.ndarray, b_free: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Matches (words, start in item, start in document) of s unmarked words or more that can't grow at either end."""
    ka, ia = _free_windows(item, a_free, s)
    kb, jb = _free_windows(doc, b_free, s)
    lo, n = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
    n = n - lo
    upto, out, x = np.cumsum(n), [], 0
    while x < len(n):  # blocks of about a million pairs, however often a window repeats
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + (1 << 20), "right")))
        k = n[x:y]
        i = np.repeat(ia[x:y], k)
        j = jb[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[x:y], k)]
        grows = (i > 0) & (j > 0)
        grows[grows] = (item[i[grows] - 1] == doc[j[grows] - 1]) & a_free[i[grows] - 1] & b_free[j[grows] - 1]
        i, j = i[~grows], j[~grows]  # a match that can begin earlier is part of a longer one
        size, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            p, q = i[live] + size[live], j[live] + size[live]
            inside = (p < len(item)) & (q < len(doc))
            live, p, q = live[inside], p[inside], q[inside]
            live = live[(item[p] == doc[q]) & a_free[p] & b_free[q]]
            size[live] += 1
        long = size >= s
        out += zip(size[long].tolist(), i[long].tolist(), j[long].tolist(), strict=True)
        x = y
    return out


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, words) of two sequences of word hashes."""
    a_free, b_free, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    s = min(len(item), len(doc))
    while s >= min_match:
        found = _maximal(item, doc, a_free, b_free, s)
        longest = max((k for k, *_ in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        marked = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if a_free[i : i + k].all() and b_free[j : j + k].all():
                a_free[i : i + k], b_free[j : j + k], marked = False, False, True
                out.append((i, j, k))
        if not marked:  # else search again: what overlapped a tile may still have free parts of this length
            s = s // 2 if s > 2 * min_match else min_match if s > min_match else 0
    return sorted(out)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.k, self.ids = min_match, [r[0] for r in rows]
        w = W.split([normal(r[1]) for r in rows])
        h = W.hashes(w)
        self.items = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        keys, at = W.windows(h, w.first, min_match)
        order = np.argsort(keys, kind="stable")
        owner = w.text_of()[at] if len(at) else np.zeros(0, np.int64)
        self.keys, self.owner, self.at = keys[order], owner[order], (at - w.first[owner])[order] if len(at) else at
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys & W.U((1 << 22) - 1)] = True

    def matches(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, list]]:
        """(text, item, coverage, tiles) of the pairs at `threshold` or more."""
        w = W.split([normal(t) for t in texts])
        h = W.hashes(w)
        keys, at = W.windows(h, w.first, self.k)
        maybe = np.flatnonzero(self.filter[keys & W.U((1 << 22) - 1)])
        keys, at = keys[maybe], at[maybe]
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        if not n.sum():
            return
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = np.repeat(at, n)
        text = np.searchsorted(w.first, at, side="right") - 1
        item = self.owner[entry]
        order = np.lexsort((item, text))
        text, item, at, seat = text[order], item[order], at[order], self.at[entry][order]
        edges = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]), [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            t, i = int(text[a]), int(item[a])
            words = self.items[i]
            could = W.covered(np.unique(seat[a:b]), self.k, len(words)).sum()  # no tiling covers more
            if could < threshold * len(words):
                continue
            # only words under a seed can be in a tile; what lies between becomes one word that matches nothing
            first = w.first[t]
            length = int(w.first[t + 1] - first)
            near = W.covered(np.unique(at[a:b] - first), self.k, length)
            own = np.where(near, h[first : first + length], W.U(0))
            keep = near | np.concatenate(([False], near[:-1]))
            back = np.flatnonzero(keep)
            found = tiles(words, own[keep], self.k)
            coverage = sum(k for *_, k in found) / len(words)
            if coverage >= threshold:
                yield t, i, coverage, [(x, int(back[y]), k) for x, y, k in found]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about `block_bytes` of text."""
    items = narrow(benchmark, "item_id", "text")
    n = max(1, math.ceil(text_bytes(items) / block_bytes))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted((tuple(r) for r in rows), key=repr)


def _hits(index: Index, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, list]]:
    """`Index.matches` over slices of the texts that bound its memory."""
    size = np.cumsum([len(t or "") for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(size // _TEXT_BYTES)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            for t, i, c, x in index.matches(texts[a:b], threshold):
                yield a + t, i, c, x


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item that it holds: doc_id, item_id, coverage, tiles (starts and lengths in words)."""
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    names = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": benchmark.schema["item_id"].dataType.simpleString()}
    schema = f"doc_id {names['doc_id']}, item_id {names['item_id']}, coverage double, tiles array<struct<item_word:int,doc_word:int,words:int>>"
    tile = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))

    def searcher(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for batch in sliced(batches):
                hits = list(_hits(index, batch["text"].to_pylist(), threshold))
                columns = [
                    batch["doc_id"].take(pa.array([t for t, *_ in hits], pa.int64())),
                    pa.array([index.ids[i] for _, i, *_ in hits], id_type),
                    pa.array([c for *_, c, _ in hits], pa.float64()),
                    pa.array([[{"item_word": i, "doc_word": j, "words": k} for i, j, k in x] for *_, x in hits], tile),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "tiles"])

        return search

    d, out = narrow(docs, "doc_id", "text"), None
    for rows in _blocks(benchmark, block_bytes):
        found = d.mapInArrow(searcher(docs.sparkSession.sparkContext.broadcast(rows)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without the contaminated documents: one scan, a filter for each block of the benchmark."""

    def keeper(shared):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for batch in sliced(batches):
                clean = np.ones(len(batch), bool)
                for t, *_ in _hits(index, batch.column(at).to_pylist(), threshold):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        return keep

    at, out = docs.columns.index("text"), docs
    for rows in _blocks(benchmark, block_bytes):
        out = out.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(rows)), docs.schema)
    return out
