"""Substring deduplication: Rabin-Karp hashes of every window of `window` words, counted over the corpus.

A word goes if a window that covers it has a word sequence that also starts anywhere else,
in the same document or another; windows are judged on the input. Overlapping repeated windows
merge into maximal removal intervals.

Defined results: a null or empty text has no words and an empty kept text; a text of fewer than
`window` words loses none; repeated rows (same id, same text) are copies of each other, so both
lose what they share; null ids are kept as they are; extra columns are ignored; an empty table
gives an empty result. Windows are compared by 64-bit hashes of well-mixed words: among n
windows about n^2 / 2^65 pairs collide by chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from piispan.llm import exchange as X
from piispan.llm import words as W
from piispan.llm.common import n_chunks

WINDOW = 35
SCHEMA = "doc_id {id}, n_words bigint, n_removed bigint, kept_text string, removed array<struct<first_word:int,end_word:int>>"


def _hashed(t: pa.Table, k: int):
    docs = X.unpacked(t)
    w = W.split(X.texts(docs))
    h, at = W.windows(W.hashes(w), w.first, k)
    keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    return docs, w, at, keys, inverse, counts


def _repeated(bodies: list[bytes]) -> list[np.ndarray]:
    """For each cell of a bucket, which of its keys another cell has too."""
    cells = [X.unpack_sorted(b) for b in bodies]
    keys = np.concatenate(cells)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(keys), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.split(hit, np.cumsum([len(c) for c in cells])[:-1])


def _kept(w: W.Words, gone: np.ndarray) -> list[bytes]:
    """Each text's words that stay, joined by one space."""
    s, e = w.starts[~gone], w.ends[~gone]
    data = w.data.copy()
    data[e] = 32
    step = np.zeros(len(data), dtype=np.int8)
    step[s] = 1
    step[e] = -1
    mask = np.cumsum(step, dtype=np.int8).astype(bool)
    mask[e] = True
    out = data[mask].tobytes()
    size = np.concatenate(([0], np.cumsum(np.where(gone, 0, w.ends - w.starts + 1))))[w.first]
    return [out[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]


def _intervals(w: W.Words, gone: np.ndarray) -> pa.Array:
    n = len(gone)
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[w.first] = True
    prev = np.concatenate(([False], gone))
    nxt = np.concatenate((gone, [False]))
    starts = np.flatnonzero(nxt & (~prev | breaks))
    ends = np.flatnonzero(prev & (~nxt | breaks))
    base = w.first[np.searchsorted(w.first, starts, side="right") - 1]
    structs = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], names=["first_word", "end_word"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, w.first).astype(np.int32)), structs)


CELLS = "slot int, chunk int, range int, body binary"
MERGED = "bucket int, slot int, body binary"
ANSWERS = "slot int, bucket int, body binary"


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_text, removed (word intervals).

    Chunks and buckets of the hash space meet in two steps. Of n chunks, about sqrt(n) make a group, and sqrt(n) buckets a range: a chunk sends a
    cell for each range; a slot (a group and a range) merges its cells and sends one for each bucket of the range; buckets answer
    slots, and slots their chunks. So there are some n^1.5 cells, not n^2, and a key that many chunks of a group have goes on once.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    n = n_chunks(docs)
    side = math.isqrt(n - 1) + 1
    id_type = docs.schema["doc_id"].dataType
    chunks = X.dealt(X.chunked(docs, n), n, "chunk")

    def send(key, t):
        chunk = key[0].as_py()
        _, _, _, keys, _, _ = _hashed(t, window)
        edge = X.bounds(keys, side)
        full = [r for r in range(side) if edge[r + 1] > edge[r]]
        first = chunk // side * side
        return pa.table({"slot": pa.array([first + r for r in full], pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "range": pa.array(full, pa.int32()), "body": pa.array([X.pack_sorted(keys[edge[r] : edge[r + 1]]) for r in full], pa.binary())})

    def joined(t):
        """A slot's cells, its distinct keys, where each cell's keys are among them, and which more than one cell has."""
        t = t.sort_by("chunk")
        cells = [X.unpack_sorted(b) for b in t["body"].to_pylist()]
        keys, inverse, counts = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        return t, keys, np.split(inverse, np.cumsum([len(c) for c in cells])[:-1]), counts > 1

    def parts(keys, r):
        """The buckets of a range, as (bucket, from, to) among sorted keys."""
        edge = X.bounds(keys, side * side)
        return [(b, edge[b], edge[b + 1]) for b in range(r * side, (r + 1) * side) if edge[b + 1] > edge[b]]

    def merge(key, t):
        t, keys, _, _ = joined(t)
        own = parts(keys, t["range"][0].as_py())
        return pa.table({"bucket": pa.array([b for b, *_ in own], pa.int32()), "slot": pa.array([key[0].as_py()] * len(own), pa.int32()), "body": pa.array([X.pack_sorted(keys[a:e]) for _, a, e in own], pa.binary())})

    def answer(key, t):
        hits = _repeated(t["body"].to_pylist())
        some = [i for i, x in enumerate(hits) if x.any()]
        slot = t["slot"].to_pylist()
        return pa.table({"slot": pa.array([slot[i] for i in some], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(some), pa.int32()), "body": pa.array([np.packbits(hits[i]).tobytes() for i in some], pa.binary())})

    def spread(key, t, answers):
        if not len(t):
            return pa.table({"chunk": pa.array([], pa.int32()), "range": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        t, keys, places, hit = joined(t)
        r = t["range"][0].as_py()
        at = {b: (a, e) for b, a, e in parts(keys, r)}
        for b, bits in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
            a, e = at[b]
            hit[a:e] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=e - a).astype(bool)
        some = [(c, hit[p]) for c, p in zip(t["chunk"].to_pylist(), places, strict=True) if hit[p].any()]
        return pa.table({"chunk": pa.array([c for c, _ in some], pa.int32()), "range": pa.array([r] * len(some), pa.int32()), "body": pa.array([np.packbits(x).tobytes() for _, x in some], pa.binary())})

    def remove(key, t, answers):
        rows, w, at, keys, inverse, counts = _hashed(t, window)
        edge, hit = X.bounds(keys, side), counts > 1
        for r, bits in zip(answers["range"].to_pylist(), answers["body"].to_pylist(), strict=True):
            a, e = edge[r], edge[r + 1]
            hit[a:e] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=e - a).astype(bool)
        gone = W.covered(at[hit[inverse]], window, int(w.first[-1]))
        total = np.concatenate(([0], np.cumsum(gone)))[w.first]
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(w.counts(), pa.int64()), "n_removed": pa.array(np.diff(total), pa.int64()), "kept_text": pa.array(_kept(w, gone), pa.binary()).cast(pa.string()), "removed": _intervals(w, gone)})

    cells = X.dealt(chunks.groupBy("chunk").applyInArrow(send, CELLS), n, "slot")
    merged = X.dealt(cells.groupBy("slot").applyInArrow(merge, MERGED), n, "bucket")
    answers = merged.groupBy("bucket").applyInArrow(answer, ANSWERS)
    told = cells.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(spread, "chunk int, range int, body binary")
    id_name = id_type.simpleString() if not isinstance(id_type, T.NullType) else "string"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, SCHEMA.format(id=id_name))
