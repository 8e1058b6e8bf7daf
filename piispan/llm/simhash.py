"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments: three of 21 or 22 bits, or two of 32 bits once there are more fingerprints than short
segments tell apart (`MOST_SHORT`). Two fingerprints at a distance of 4 or less differ in at most one bit in one
of three segments, or two in one of two. The table side files each distinct fingerprint under its segments' values; the probe side
enumerates the ball of that radius around each segment's value, fetches what is filed there and verifies the whole distance.

Equal fingerprints are one node, so exact copies never meet in pairs. Within a bucket of keys,
verified links are reduced to a spanning forest before they leave it, so a bucket of n emits fewer
than n links however many pairs it verifies. A key under which more than `block` fingerprints are
filed is compared in blocks, each table block with each probe block, in tasks of their own; such keys are at most `MOST_HOT`.
Fingerprints and components that very many rows share meet their class by broadcast of the few hottest, so
no key is one task's.

Defined results: null and empty texts have the fingerprint zero and link like any other; texts of
fewer words than a shingle hash their whole word sequence; repeated rows share a fingerprint; null
ids never become a component's id unless all its ids are null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piispan.llm import words as W
from piispan.llm.common import cut, join_hot, n_partitions, narrow, sliced
from piispan.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit and bits of each segment: short ones, and long ones for more fingerprints than `MOST_SHORT`.
SHORT, LONG, MOST_SHORT = ((0, 21), (21, 21), (42, 22)), ((0, 32), (32, 32)), 1 << 25
#: Fingerprints in a block, keys that may have blocks, rows in a task's group.
MOST_HOT, GROUP_ROWS = 100_000, 2_000_000
BLOCK = 16384
_SPREAD = np.array([[(b >> (7 - i)) & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()
_BYTES = 2 << 20


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: a bit is 1 if over half the shingles' XXH64 have it."""
    w = W.split(texts, lower=True)
    n = w.counts()
    # words joined by one space: what lies between two words becomes one byte
    length = w.ends - w.starts
    place = np.concatenate(([0], np.cumsum(length + 1)))
    step = np.zeros(len(w.data), np.int8)
    step[w.starts], step[w.ends] = 1, -1
    mask = np.cumsum(step, dtype=np.int8).astype(bool)
    mask[w.ends] = True
    data = w.data.copy()
    data[w.ends] = 32
    joined = data[mask].tobytes()
    counts = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    text_of = np.repeat(np.arange(len(n)), counts)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = w.first[:-1][text_of] + nth
    end = np.minimum(begin + shingle, w.first[1:][text_of])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[end] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(begin))
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # bits are counted in byte lanes: 8 counters in a word, sums over runs of at most 255 shingles
    runs = np.flatnonzero((nth % 255 == 0))
    lanes = np.add.reduceat(_SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)], runs, axis=0)
    per_run = lanes.view(np.uint8).reshape(len(runs), 64).astype(np.int64)
    owners = text_of[runs]
    at = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
    ones = np.add.reduceat(per_run, at, axis=0)
    bits = 2 * ones > counts[owners[at]][:, None]
    out[owners[at]] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch["text"].cast(pa.binary()).to_pylist()
        size = np.cumsum([len(t or b"") for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(size // _BYTES)) + 1).tolist(), len(texts)]
        fp = [fingerprints(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c != "text"} | {"fp": pa.array(fp.view(np.int64))})


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of id and text unless `docs` has one), fp (the fingerprint as a signed long)."""
    d = docs.select("doc_id", "text", "h") if isinstance(docs.schema["h"].dataType if "h" in docs.columns else None, T.StructType) else narrow(docs, "doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text"))
    return d.mapInArrow(_fingerprint_batches, T.StructType([d.schema["doc_id"], d.schema["h"], T.StructField("fp", T.LongType())]))


def _key(i: int, value: Column) -> Column:
    return F.lit(i << 33) + value


def _segment(first: int, bits: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))


def _filed(segments) -> Column:
    return F.array(*[_key(i, _segment(*s)) for i, s in enumerate(segments)])


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` bits."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def _probes(fps: DataFrame, segments, radius: int) -> DataFrame:
    """fp and each key in the balls around its segments' values."""
    masks = F.array(*[F.lit((i << 33) + m) for i, (_, bits) in enumerate(segments) for m in _ball(bits, radius)])
    near = F.lit(0)
    for i, s in enumerate(segments):
        near = _segment(*s) if not i else F.when(F.col("mask") >= i << 33, _segment(*s)).otherwise(near)
    return fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("mask").bitwiseXOR(near).alias("key"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b, with one link from each node to its component's least."""
    nodes, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _verified(distance: int):
    def links(key, t):
        cell = t["cell"].to_numpy()
        fp, probe = t["fp"].to_numpy().view(np.uint64), t["probe"].to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        cell, fp, probe = cell[order], fp[order], probe[order]
        tc, tf, pc, pf = cell[~probe], fp[~probe], cell[probe], fp[probe]
        lo, hi = np.searchsorted(tc, pc, "left"), np.searchsorted(tc, pc, "right")
        some = np.flatnonzero(hi > lo)
        pf, lo, n = pf[some], lo[some], (hi - lo)[some]
        found = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        upto = np.cumsum(n)
        at = 0
        while at < len(n):  # blocks of about 4 million pairs
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 22), "right")))
            k = n[at:to]
            left = np.repeat(pf[at:to], k)
            right = tf[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)]
            near = (left > right) & (np.bitwise_count(left ^ right) <= distance)
            if near.any():
                found = forest(np.concatenate((found[0], left[near])), np.concatenate((found[1], right[near])))
            at = to
        return pa.table({"a": pa.array(found[0].view(np.int64)), "b": pa.array(found[1].view(np.int64))})

    return links


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, segments=None) -> DataFrame:
    """Links a-b between distinct fingerprints (column fp) whose components are those of all pairs at `distance` or less."""
    count = fps.count()
    segments = segments or (SHORT if count <= MOST_SHORT else LONG)
    radius = distance // len(segments)
    block = max(block, len(segments) * count // MOST_HOT)  # so at most MOST_HOT keys are hot
    filed = fps.select("fp", F.explode(_filed(segments)).alias("key"))
    hot = filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = filed.withColumn("probe", F.lit(False)).unionByName(_probes(fps, segments, radius).withColumn("probe", F.lit(True)))
    rows = rows.join(F.broadcast(hot), rows["key"] == hot["hot_key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # cell (i, j): table block i with probe block j of a key
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("probe"), F.transform(others, lambda i: i * F.col("blocks") + mine)).otherwise(F.transform(others, lambda j: mine * F.col("blocks") + j))
    rows = rows.select("fp", "probe", "key", F.explode(cells).alias("part")).withColumn("cell", F.xxhash64("key", "part"))
    each = len(segments) + sum(len(_ball(bits, radius)) for _, bits in segments)
    n = max(4 * n_partitions(fps.sparkSession), each * count // GROUP_ROWS)
    rows = rows.select("fp", "probe", "cell", F.pmod(F.shiftrightunsigned("cell", 20), F.lit(n)).cast("int").alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(_verified(distance), "a bigint, b bigint")


def _unsigned(root: Column) -> Column:
    return F.lpad(F.lower(F.hex(root)), 16, "0")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """fp, root (the least fingerprint of its component), component_id, n (rows of `prints` that have it)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(near_links(nodes.select("fp"), distance))
    named = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    return cut(join_hot(named, ids, "root").select("fp", "root", "component_id", F.col("rows").alias("n")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of `docs`: doc_id, h, fingerprint, component_id (the least doc_id reachable), root (its fingerprint)."""
    prints = cut(add_fingerprints(docs))
    return join_hot(prints, _classes(prints, distance), "fp").select("doc_id", "h", _unsigned(F.col("fp")).alias("fingerprint"), "component_id", "root")


def keep_one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each component: that with the least id.

    Rows are told apart by 128 bits of hashes of id and text, so n rows collide by chance with n^2 / 2^129.
    """
    hashes = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("h2")]
    found = near_duplicates(docs.select("doc_id", "text", F.struct(*hashes).alias("h")), distance)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("best"))
    chosen = best.select(F.col("best.h.h1").alias("c1"), F.col("best.h.h2").alias("c2")).distinct()
    # equal rows are made one first, on the map side already, so that however many there are they are no task's alone
    rows = docs.select(*hashes, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).dropDuplicates(["h1", "h2"])
    return rows.join(chosen, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left_semi").select("row.*")
