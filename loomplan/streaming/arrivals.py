"""New products recommended as they arrive, against a published build.

Products and the features of their images are two streams.  A product that has an image
waits in the join's state until its features come, others go on at once.  Each
micro-batch is joined with the build's static tables and written under its number, so a
batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from loomplan.operators import features, recommend, similarity
from loomplan.policy import MATCH
from loomplan.sources.stage import settle

MODEL = ("history", "priors", "ceilings", "tau", "horizon")


@dataclass(frozen=True)
class Build:
    """What a published build gives for scoring: saved vectors, the fitted model's tables and the calibration of distances."""

    vectors: DataFrame
    model: Mapping[str, DataFrame]
    median: float
    scale: float

    def recommended(self, products: DataFrame) -> DataFrame:
        """Recommendations of ``products`` (with vector, null without an image) whose item type the history has."""
        known = features.of_known_types(products, self.model["history"])
        left = known.where("vector is not null").select("id", "ordinal", "vector")
        ranked = similarity.whole_one_stage(left, self.vectors, known.select("id"), MATCH.published, calibrated=(self.median, self.scale))
        return recommend.recommendations(known.drop("vector"), ranked, self.model)


def save_build(build: Build, path: str) -> None:
    """Write all tables of a build that a stream's jobs read again and again."""
    build.vectors.write.parquet(f"{path}/vectors")
    for name in MODEL:
        build.model[name].write.parquet(f"{path}/{name}")
    build.vectors.sparkSession.createDataFrame([(build.median, build.scale)], "median double, scale double").write.parquet(f"{path}/calibration")


def load_build(spark: SparkSession, path: str) -> Build:
    median, scale = spark.read.parquet(f"{path}/calibration").first()
    return Build(spark.read.parquet(f"{path}/vectors"), {name: spark.read.parquet(f"{path}/{name}") for name in MODEL}, median, scale)


def complete(products: DataFrame, pictures: DataFrame, *, wait: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Streamed products with the vectors of their images.

    products: id, has_image, arrived and what else is wanted; pictures: id, vector, seen.
    Repeats of an id within ``late`` are dropped on both sides.  A product and its picture
    find each other if they come within ``wait`` of each other, in either order; state
    older than that is given up.  A product with an image that never comes gives no row.
    """
    asked = products.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["id"])
    seen = pictures.select(F.col("id").alias("_id"), "vector", "seen").withWatermark("seen", late).dropDuplicatesWithinWatermark(["_id"])
    near = F.expr(f"id = _id AND seen BETWEEN arrived - INTERVAL {wait} AND arrived + INTERVAL {wait}")
    found = asked.where("has_image").join(seen, near).drop("_id", "seen")
    return found.unionByName(asked.where("NOT has_image").withColumn("vector", F.lit(None).cast(pictures.schema["vector"].dataType)))


def serve(products: DataFrame, pictures: DataFrame, build: Build, out: str, checkpoint: str, *, wait: str = "30 days", late: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Start recommending; ``once``: all that is there, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        # Written first: each use of a micro-batch would run the join and its state again.
        rows = settle(batch.drop("arrived"), "arrived")
        if not rows.isEmpty():
            build.recommended(rows).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    writer = complete(products, pictures, wait=wait, late=late).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def served(spark: SparkSession, out: str) -> DataFrame:
    """All recommendations so far; of a product that came again, those of the latest batch."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch_id")))
    return spark.read.parquet(out).withColumn("_n", last).where("_n = 1").drop("_n", "batch_id")
