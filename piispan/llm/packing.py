"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most `capacity` different ones, so the plan is
made from their histogram: the reduction fixes bins that provably dominate (a piece that nothing
fits with; a piece and the one that fills its bin; a piece and the best two where at most two fit),
as often as their counts allow; best fit, longest first, packs the rest, whole groups of equal bins
at a time. The plan lists, for ranges of ranks among pieces of one length, the bins and offsets they go
to: its size depends on the capacity, not on the number of documents. Ranks are made in two
levels (within a hash part, then parts summed up), so no length, however common, is one task.

Defined results: a null or empty text is one piece, the end id alone; longer documents are cut into
pieces of `capacity`, the last may be shorter; repeated rows are packed each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piispan.llm.common import n_partitions, narrow, sliced, stored
from piispan.llm.tokenizing import encoder, public_path

CAPACITY, END_ID = 4096, 1


class _Sizes:
    """A multiset of sizes."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sorted = sorted(self.n)

    def take(self, size: int, n: int = 1) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sorted.pop(bisect.bisect_left(self.sorted, size))

    def largest(self, most: int) -> int:
        i = bisect.bisect_right(self.sorted, most)
        return self.sorted[i - 1] if i else 0

    def smallest_sum(self, k: int) -> float:
        total = 0
        for s in self.sorted:
            m = min(k, self.n[s])
            total, k = total + m * s, k - m
            if not k:
                return total
        return float("inf")

    def best_pair(self, most: int) -> tuple[int, int]:
        """(a, b), a >= b, with the largest sum of at most `most`; of equal sums, the largest a."""
        best, i, j = (0, 0), 0, len(self.sorted) - 1
        while i <= j:
            b, a = self.sorted[i], self.sorted[j]
            if a + b > most or (i == j and self.n[a] < 2):
                j -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            i += 1
        return best


def reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Bins that can be fixed without losing optimality, as (sizes, how many), and the sizes left."""
    left, fixed = _Sizes(counts), []
    for w in sorted(counts, reverse=True):
        while left.n.get(w):
            room, have = capacity - w, left.n[w]
            left.take(w)  # look at the others
            k = left.largest(room)
            bin_, times = None, 0
            if not k:
                bin_, times = [w], have
            else:
                pair = (have // 2) if k == w else min(have, left.n[k])
                if k == room or left.smallest_sum(2) > room:
                    bin_, times = [w, k], pair
                elif left.smallest_sum(3) > room:
                    a, b = left.best_pair(room)
                    if k >= a + b:
                        bin_, times = [w, k], pair
                    elif a == k and (a == b or sum(left.n[s] for s in left.sorted[bisect.bisect_right(left.sorted, b) : bisect.bisect_left(left.sorted, a)]) <= 1):
                        bin_ = [w, a, b]
                        need = {s: bin_.count(s) for s in bin_}
                        times = min((left.n.get(s, 0) + (s == w)) // m for s, m in need.items())
            left.n[w] = left.n.get(w, 0) + 1
            if left.n[w] == 1:
                bisect.insort(left.sorted, w)
            if not bin_:
                break
            for s in bin_:
                left.take(s, times)
            fixed.append((bin_, times))
    return fixed, dict(left.n)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, rank from, rank to, first bin, pieces a bin, offset), sorted, and the number of bins."""
    rows, used, bins = [], dict.fromkeys(counts, 0), 0

    def place(size: int, n_bins: int, per: int, first: int, offset: int) -> None:
        a = used[size]
        used[size] = a + n_bins * per
        rows.append((size, a, used[size], first, per, offset))

    fixed, left = reduction(counts, capacity)
    for sizes, times in fixed:
        at = 0
        for s in dict.fromkeys(sizes):
            place(s, times, sizes.count(s), bins, at)
            at += s * sizes.count(s)
        bins += times
    groups: dict[int, list[tuple[int, int]]] = {}  # open bins by the room left
    rooms: list[int] = []

    def opened(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            i = bisect.bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                first, k = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, first, k = capacity, bins, -(-n // (capacity // w))
                bins += k
            per = room // w
            full = min(k, n // per)
            if full:
                place(w, full, per, first, capacity - room)
                opened(room - per * w, first, full)
                n -= full * per
            if full < k and n:  # then n < per
                place(w, 1, n, first + full, capacity - room)
                opened(room - n * w, first + full, 1)
                full, n = full + 1, 0
            opened(room, first + full, k - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), bins


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, h, piece, start, length, ids (little-endian unsigned 32-bit)."""
    end = int(end_id).to_bytes(4, "little")
    names = ("doc_id", "h", "piece", "start", "length", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in sliced(batches):
            which, nth, ids = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                b = enc.encode(text) + end
                for at in range(0, len(b), 4 * capacity):
                    which.append(i)
                    nth.append(at // (4 * capacity))
                    ids.append(b[at : at + 4 * capacity])
            piece = np.array(nth, np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(which, pa.int64())), batch["h"].take(pa.array(which, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=names)

    d = narrow(docs, "doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text"))
    return d.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, piece int, start bigint, length bigint, ids binary")


@dataclass
class PackedCorpus:
    """pieces: with their ids; placements: where each goes, with `ids_crc32`; n_sequences."""

    pieces: DataFrame
    placements: DataFrame
    n_sequences: int

    def sequences(self) -> DataFrame:
        """sequence_id, ids: the packed sequences themselves, at most `capacity` ids each."""
        on = ["doc_id", "h", "piece"]
        p, q = self.pieces.alias("p"), self.placements.select(*on, "sequence_id", "offset").distinct().alias("q")
        joined = p.join(q, (F.col("p.doc_id").eqNullSafe(F.col("q.doc_id"))) & (F.col("p.h") == F.col("q.h")) & (F.col("p.piece") == F.col("q.piece")))
        rows = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return rows.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> PackedCorpus:
    spark = docs.sparkSession
    pieces = stored(encoded_pieces(docs, tokenizer or public_path("word_bpe_49k.json"), capacity, end_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, n_bins = packing_plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    parts = 4 * n_partitions(spark)
    rows = pieces.select("doc_id", "h", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h", "piece"), F.lit(parts)).cast("int"))
    sizes = pieces.select("length", F.pmod(F.xxhash64("h", "piece"), F.lit(parts)).cast("int").alias("part")).groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("l"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("h", "piece", "doc_id")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select("doc_id", "h", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first_rank, _, first_bin, per, offset = shared.value.T
        key = (size << 44) + first_rank
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - first_rank[i]
            columns = {c: batch[c] for c in ("doc_id", "h", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(first_bin[i] + nth // per[i]), "offset": pa.array(offset[i] + nth % per[i] * length)})

    id_name = docs.schema["doc_id"].dataType.simpleString()
    placements = ranked.mapInArrow(place, f"doc_id {id_name}, h bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return PackedCorpus(pieces, placements, n_bins)
