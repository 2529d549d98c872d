"""A stream of queries against a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.search import Block, top_k


def search_stream(queries: DataFrame, corpus: DataFrame, block: Block, k: int, out: str, checkpoint: str, skip_self: bool = True) -> StreamingQuery:
    """Starts a query that answers each micro-batch of ``queries(id, vec)`` and writes
    ``(qid, did, score, rk)`` to ``out/batch=<n>``. A batch that is run again after a
    failure overwrites its own folder, so each answer is there once. The corpus is
    read anew per batch unless it is cached. Scoring keeps no state, so there is no
    watermark: late queries are answered like others."""

    def answer(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            top_k(batch, corpus, block, k, skip_self).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
