"""Token shards as sorted string tables.

A shard file holds documents in ascending key order:

    blocks   entries of (shared u32, suffix length u32, token count u32, suffix, token ids); the key is
             the first `shared` bytes of the entry before, then the suffix; a block starts anew (shared 0)
    index    for each block: key length u32, first key, offset u64, bytes u32, entries u32, crc32 u32
    Bloom    10 bits a key, 7 probes
    footer   index offset u64, index bytes u64, Bloom offset u64, Bloom bytes u64, documents u64,
             tokens u64, bytes of an id u8, magic 8 bytes

Keys are bytes that sort as the identifiers do: null first, then integers or strings. A lookup asks the Bloom
filter, finds the block by binary search in the index, and reads that block alone.

Documents are range-partitioned by identifier; each task writes one file in the given folder under
a name of its own and renames it when whole, so a task that runs again replaces its file. The folder can be on any
file system that Arrow opens by URI.

Defined results: a null or empty text has the end id alone; repeated identifiers are all kept, in order of
their texts' hashes; a null identifier sorts first; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piispan.llm.common import fresh_path, n_chunks, n_partitions, narrow, sliced, stored
from piispan.llm.tokenizing import encoder, public_path

MAGIC = b"PSPNSST1"
BLOCK_BYTES, BLOOM_BITS, BLOOM_PROBES = 64 << 10, 10, 7
SHARD_TEXT = 128 << 20
_ENTRY, _INDEX, _FOOTER = struct.Struct("<III"), struct.Struct("<QIII"), struct.Struct("<QQQQQQB8s")


def key_of(identifier) -> bytes:
    if identifier is None:
        return b"\0"
    if isinstance(identifier, int):
        return b"\1" + (identifier + (1 << 63)).to_bytes(8, "big")
    return b"\2" + str(identifier).encode()


def identifier_of(key: bytes):
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode()


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Takes keys in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.block_bytes, self.first, self.last, self.index, self.keys, self.tokens = [], 0, b"", b"", [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys have to ascend")
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        raw = ids.astype(f"<u{self.width}").tobytes()
        entry = _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + raw
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            self.index.append(struct.pack("<I", len(self.first)) + self.first + _INDEX.pack(self.at, len(raw), len(self.block), zlib.crc32(raw)))
            self.out.write(raw)
            self.at += len(raw)
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bloom.tobytes() + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.width, MAGIC))


class ShardReader:
    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.documents, self.tokens, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bloom = self.file.read_at(bloom_size, bloom_at)
        self.first, self.blocks, raw, at = [], [], self.file.read_at(index_size, index_at), 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 4], "little")
            self.first.append(raw[at + 4 : at + 4 + n])
            self.blocks.append(_INDEX.unpack_from(raw, at + 4 + n))
            at += 4 + n + _INDEX.size

    def block(self, i: int) -> list[tuple[bytes, np.ndarray]]:
        offset, size, n, crc = self.blocks[i]
        raw, at, key, out = self.file.read_at(size, offset), 0, b"", []
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        for _ in range(n):
            shared, suffix, count = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + suffix]
            at += suffix
            out.append((key, np.frombuffer(raw, f"<u{self.width}", count, at)))
            at += count * self.width
        return out

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def get(self, identifier) -> list[np.ndarray]:
        """Token ids of the documents with this identifier: none, one, or more if it repeats."""
        key = key_of(identifier)
        if not self.may_have(key):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[i] > key:
                break
            out += [ids for k, ids in self.block(i) if k == key]
        return out

    def close(self) -> None:
        self.file.close()


SHARDS = "uri string, shard int, documents bigint, tokens bigint, bytes bigint"


def write_shards(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes and writes all documents; a row for each shard, with the tokens of all shards before it (`start`)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, out, writer = encoder(tokenizer), TaskContext.get(), None, None
        name = f"{uri}/shard-{task.partitionId():06d}.sst"
        fs, path = pafs.FileSystem.from_uri(name)
        part = f"{path}.{task.taskAttemptId()}.part"
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in sliced(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(part, buffer_size=1 << 20)
                    writer = ShardWriter(out, width)
                writer.add(key_of(doc_id), np.frombuffer(enc.encode(text) + end, "<u4"))
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_pydict({"uri": [name], "shard": pa.array([task.partitionId()], pa.int32()), "documents": [len(writer.keys)], "tokens": [writer.tokens], "bytes": [size]})

    d = narrow(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    n = n_chunks(docs, chunk_bytes=SHARD_TEXT)
    shards = stored(d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(write, SHARDS), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row a shard
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (tokens of all documents before it), ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist(), strict=True):
                shard = ShardReader(uri)
                for i in range(len(shard.blocks)):
                    entries = shard.block(i)
                    counts = [len(ids) for _, ids in entries]
                    starts = start + np.concatenate(([0], np.cumsum(counts)))
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([identifier_of(k) for k, _ in entries], pa.string() if id_type == "string" else pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes() for _, ids in entries], pa.binary())})
                shard.close()

    n = max(1, min(shards.count(), 16 * n_partitions(shards.sparkSession)))
    out = shards.select("uri", "start", "shard").repartition(n, "shard").mapInArrow(read, f"doc_id {'string' if id_type == 'string' else 'bigint'}, start bigint, ids binary")
    return out if id_type in ("string", "bigint") else out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def lookup(spark: SparkSession, shards: DataFrame, identifiers: list) -> dict:
    """Token ids by identifier, by Bloom filter and binary search in each shard; for a few identifiers."""
    found: dict = {}
    for r in shards.select("uri").toLocalIterator():
        shard = ShardReader(r["uri"])
        for x in identifiers:
            if got := shard.get(x):
                found.setdefault(x, []).extend(got)
        shard.close()
    return found


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes all documents as shards in the shared folder and reads them back."""
    shards = write_shards(docs, fresh_path(docs.sparkSession, "shards"), tokenizer, end_id)
    return read_shards(shards, docs.schema["doc_id"].dataType.simpleString())
