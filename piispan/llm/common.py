"""Things that every operator here needs: shared folders, sizes, column selection."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.sources.shared import fresh_path, shared_dir

#: Text that one task holds at a time; bounds the Python workers' memory.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `cut`, but as Parquet, so that later reads can leave columns out."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """Like `stored`; then lets Spark drop the shuffle files of the finished job, which it does once the driver has
    collected the job's plan, so that a chain of such jobs needs the disk of its largest one only."""
    out = stored(df, name)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table (one column is read)."""
    return docs.select(F.sum(F.octet_length(column))).first()[0] or 0


def n_chunks(docs: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks such that each holds about `chunk_bytes` of text, and every core has work."""
    return max(n_partitions(docs.sparkSession), math.ceil(text_bytes(docs, column) / chunk_bytes), 1)


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with any names can't clash.

    Names are matched exactly; a column that is missing becomes a null string.
    """
    have = set(docs.columns)
    return docs.select(*[docs[f"`{n}`"].alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


#: Keys that are joined by broadcast: at most so many, each of more rows than `HOT_ROWS`.
HOT_KEYS, HOT_ROWS = 1024, 100


def join_hot(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join by a column `key` of both. In `small` the key is unique and `n` tells how many rows of `big` have it.

    The keys with the most rows meet their partners by broadcast (`HOT_KEYS` rows at most), where they stand; the others
    are shuffled, and each has less than one part in `HOT_KEYS` of the rows. `n` is dropped.
    """
    hot = small.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).drop("n").withColumnRenamed(key, "hot_key")
    ids = F.broadcast(hot.select("hot_key"))
    cold = small.drop("n").withColumnRenamed(key, "cold_key")
    first = big.join(F.broadcast(hot), big[key] == hot["hot_key"]).drop("hot_key")
    rest = big.join(ids, big[key] == ids["hot_key"], "left_anti")
    return first.unionByName(rest.join(cold, rest[key] == cold["cold_key"]).drop("cold_key"))


#: Bytes of Arrow data that become Python objects at a time.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `SLICE_BYTES`, a row at least."""
    for batch in batches:
        step = max(1, len(batch) * SLICE_BYTES // max(batch.nbytes, 1))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)
