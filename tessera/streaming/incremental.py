"""Incremental linkage: new targets meet static queries as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(arrivals: DataFrame, queries: DataFrame, key: Column, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends (q, t) with equal non-empty keys for each micro-batch of the stream `arrivals` (t, ...).

    The static side is the queries, so state doesn't grow with the stream.
    """
    static = queries.select("q", key.alias("k")).where("k <> ''")
    pairs = arrivals.select("t", key.alias("k")).join(static, "k").select("q", "t")
    return pairs.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
