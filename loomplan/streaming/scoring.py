"""New products scored as they arrive against saved history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(arrivals: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, *, watermark: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Drop repeats of a product id within the watermark, and score each micro-batch.

    arrivals: a streaming DataFrame with ``id`` and ``arrived`` (timestamp).  ``score``
    joins a batch with static tables; ``sink`` writes it under its batch number, so
    that a batch repeated after a failure overwrites itself.
    """
    fresh = arrivals.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["id"])
    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(score(batch).withColumn("batch_id", F.lit(n)), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
