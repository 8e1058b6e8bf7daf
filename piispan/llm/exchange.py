"""Counting over a whole corpus without a row for each item.

Documents are dealt by hash into chunks, packed, each of a bounded size. A chunk sends its
distinct 64-bit keys as sorted, delta-packed arrays ("cells"), one for each bucket of the key
space; a bucket merges its cells and answers each chunk in the order in which the chunk sent
its keys. So a key that is everywhere counts once for a chunk, no task holds more than a
bucket or a chunk, and the answers are bits or small integers. The packed documents are
shuffled once: later steps group by the same column, and Spark reuses the exchange.

A chunk's content is a function of the rows only (hash of id and text, then sorted), so a task
that runs again after a lost executor sends the same cells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piispan.llm.common import n_partitions, narrow

CHUNKS = "chunk int, body binary"
CELLS = "bucket int, chunk int, kind int, body binary"
_FLUSH = 48 << 20


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return squeezed(sink.getvalue())


def squeezed(data) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(np.argsort(t["chunk"].to_numpy(), kind="stable"))
        ids, at = np.unique(t["chunk"].to_numpy(), return_index=True)
        t = t.drop_columns(["chunk"])
        ends = [*at[1:], len(t)]
        return pa.RecordBatch.from_pydict({"chunk": pa.array(ids, pa.int32()), "body": pa.array([_pack(t.slice(a, b - a).combine_chunks()) for a, b in zip(at, ends, strict=True)], pa.binary())})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _FLUSH:
            yield flush()
            held, size = [], 0
    if sum(len(x) for x in held):
        yield flush()


def chunked(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """Documents as packed chunks: columns chunk, body."""
    d = narrow(docs, "doc_id", "text", *columns)
    d = d.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int"))
    return d.mapInArrow(_deal, CHUNKS)


def unpacked(t: pa.Table) -> pa.Table:
    """The documents of a chunk, in an order that depends on them alone."""
    docs = pa.concat_tables([ipc.open_stream(expanded(b)).read_all() for b in t["body"].to_pylist()])
    return docs.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()


def texts(t: pa.Table) -> list[bytes | None]:
    return t["text"].cast(pa.binary()).to_pylist()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: differences as 4 low bytes and 1 to 4 high bytes, whichever is enough."""
    if not len(keys):
        return b""
    d = np.diff(keys, prepend=np.uint64(0))
    first, d[0] = keys[0], 0
    high = d >> np.uint64(32)
    top = int(high.max())
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    if top == 0:
        low = d.astype(np.uint32)
        if int(low.max()) < 1 << 24:  # 3 bytes
            return b"\x03" + int(first).to_bytes(8, "little") + np.ascontiguousarray(low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
        return b"\x04" + int(first).to_bytes(8, "little") + low.tobytes()
    size = np.dtype(kind).itemsize
    return bytes([4 + size]) + int(first).to_bytes(8, "little") + d.astype(np.uint32).tobytes() + high.astype(kind).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width, first, rest = b[0], int.from_bytes(b[1:9], "little"), b[9:]
    if width == 3:
        raw = np.zeros((len(rest) // 3, 4), np.uint8)
        raw[:, :3] = np.frombuffer(rest, np.uint8).reshape(-1, 3)
        d = raw.view("<u4").ravel().astype(np.uint64)
    elif width == 4:
        d = np.frombuffer(rest, np.uint32).astype(np.uint64)
    else:
        n = len(rest) // width
        d = np.frombuffer(rest, np.uint32, n).astype(np.uint64)
        d |= np.frombuffer(rest, {5: np.uint8, 6: np.uint16, 8: np.uint32}[width], n, 4 * n).astype(np.uint64) << np.uint64(32)
    d[0] = first
    return np.cumsum(d, dtype=np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys near the entropy of their differences: low 16 bits as they are, the rest squeezed."""
    if not len(keys):
        return b""
    d = np.diff(keys, prepend=np.uint64(0))
    first, d[0] = keys[0], 0
    return struct.pack("<QI", int(first), len(keys)) + d.astype(np.uint16).tobytes() + pack_counts([d >> np.uint64(16)])


def unpack_keys(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    first, n = struct.unpack_from("<QI", b)
    d = np.frombuffer(b, np.uint16, n, 12).astype(np.uint64) | unpack_counts(b[12 + 2 * n :])[0] << np.uint64(16)
    d[0] = first
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(arrays: list[np.ndarray]) -> bytes:
    """Equally long arrays of mostly small numbers, squeezed: a byte each; 255 stands for two bytes in a second list,
    65535 there for eight in a third."""
    parts = [struct.pack("<II", len(arrays), len(arrays[0]))]
    for x in arrays:
        x = x.astype(np.uint64)
        mid = x[x >= 255]
        large = mid[mid >= 65535]
        parts += [np.minimum(x, 255).astype(np.uint8).tobytes(), struct.pack("<II", len(mid), len(large)), np.minimum(mid, 65535).astype(np.uint16).tobytes(), large.tobytes()]
    return squeezed(b"".join(parts))


def unpack_counts(b: bytes) -> list[np.ndarray]:
    raw = expanded(b)
    k, n = struct.unpack_from("<II", raw)
    at, out = 8, []
    for _ in range(k):
        x = np.frombuffer(raw, np.uint8, n, at).astype(np.uint64)
        m, large = struct.unpack_from("<II", raw, at + n)
        at += n + 8
        mid = np.frombuffer(raw, np.uint16, m, at).astype(np.uint64)
        at += 2 * m
        mid[mid == 65535] = np.frombuffer(raw, np.uint64, large, at)
        at += 8 * large
        x[x == 255] = mid
        out.append(x)
    return out


def bounds(keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Where the keys of each of n buckets begin in a sorted array; buckets are ranges of the key space."""
    edges = np.array([(i << bits) // n for i in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def cell_table(buckets: list[int], chunks: list[int], kinds: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(chunks, pa.int32()), "kind": pa.array(kinds, pa.int32()), "body": pa.array(bodies, pa.binary())})


#: Chunks, or as much as chunks send, for one task.
CHUNKS_A_TASK = 8


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows by key over as many tasks as n chunks ask for, so that a task's share does not grow with the corpus."""
    return df.repartition(max(n_partitions(df.sparkSession), -(-n // CHUNKS_A_TASK)), *keys)
