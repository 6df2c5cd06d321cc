"""Queries that arrive as a stream, answered from a standing index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loresift.functions.text import tokens
from loresift.plans.search import Searcher


def answer(stream: DataFrame, searcher: Searcher, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write the k best documents of every arriving (query, text) to path, once each: (batch, query, doc, score, rank).

    Batches are independent of each other, so no state is kept; a batch run again overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        queries = batch.select("query", tokens("text").alias("toks"))
        found = searcher.search(queries, k).select("query", "doc", "score", "rank")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
