"""Overrides and approvals of plans, kept up to date by a stream of planners' steps.

The state says of each product of a plan when it was last overridden (and to what), undone
and approved, and of each plan when settings last cleared it, in the planner's own
numbering.  Only the last of each counts, so steps may come late, repeated and in any
order, and the state is as large as the plans.  A product is a group of its own, so a plan
of many products is dealt over all tasks, and one that is cleared costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomplan.operators import recommend

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = ("cleared", "overridden", "undone", "approved_at")


def follow_plans(log: DataFrame, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start keeping the state of plans from a stream of steps (plan_id, seq, kind, id, quantity).

    What each micro-batch changes is written under its number, over an earlier try of it:
    the last steps of each product that it touches, and of each plan that it clears
    (``whole``) when that was.
    """
    spark = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    whole = F.col("kind") == "settings"
    steps = log.where(F.col("kind").isin("settings", "override", "choose", "reset", "approve")).select(
        "plan_id", whole.alias("whole"), F.when(~whole, F.col("id").cast("string")).alias("id"), "kind", F.col("seq").cast("long").alias("seq"), F.col("quantity").cast("long").alias("quantity"))
    states = steps.groupBy("plan_id", "whole", "id").agg(recommend.last_step("settings").alias("cleared"), *recommend.last_steps())
    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"))
    spark.conf.set(name, ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(name, before)


def plans(spark: SparkSession, out: str) -> DataFrame:
    """(plan_id, id, override_quantity, approved) that hold, as ``recommend.planner_state`` gives them for the whole log."""
    changes = spark.read.parquet(out)
    # A later state of a group has no smaller numbers than an earlier one.
    now = changes.groupBy("plan_id", "whole", "id").agg(*[F.max(c).alias(c) for c in LAST], F.max_by("quantity", "overridden").alias("quantity"))
    products = now.where("not whole").drop("whole", "cleared")
    cleared = now.where("whole").select(F.col("plan_id").alias("_plan"), F.col("cleared"))
    found = products.join(cleared, F.col("plan_id").eqNullSafe(F.col("_plan")), "left").withColumn("cleared", F.coalesce("cleared", F.lit(-1)))
    return recommend.standing(found)
