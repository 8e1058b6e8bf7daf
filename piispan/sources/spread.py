"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of fewer bytes a core than this is dealt out anew before costly work.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame, tasks: int = 1) -> DataFrame:
    """The rows of a small table over all cores, `tasks` for each. A row group of a file is one task, and small files have one;
    a table of many row groups stays as it is, so no large table is ever shuffled by this."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * tasks) if estimate < cores * SPREAD_BYTES else df
