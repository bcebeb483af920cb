"""Route requests as a stream: every micro-batch is a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """requests: a streaming table of queries. Each micro-batch is answered whole
    and appended to path under its batch number, so a batch that runs twice after
    a failure replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
