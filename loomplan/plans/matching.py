"""From catalogues and vectors to ranked matches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.functions.numeric import cosine_distance, inner_product, clamp
from loomplan.operators import similarity as sim
from loomplan.plans import domain
from loomplan.policy import MatchPolicy
from loomplan.sources.stage import settle

FEATURES = ["detail", "palette", "texture"]


def retrieved(left: DataFrame, right: DataFrame, policy: MatchPolicy) -> DataFrame:
    """Nearest candidates with all distances of their other signals, computed after the limit."""
    pairs = sim.cohort_topk(left, right, policy.candidates, policy=policy).withColumnRenamed("distance", "fashion_raw")
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("item_type").alias(f"{s}_item_type"), F.col("design").alias(f"{s}_design"), *[F.col(f).alias(f"{s}_{f}") for f in FEATURES])
    both = pairs.join(side(left, "left"), "left_id").join(side(right, "right"), "right_id")
    detail = clamp(1 - inner_product(F.col("left_detail"), F.col("right_detail")), 0.0, 2.0)
    out = both.withColumns({"fashion_distance": F.round("fashion_raw", 7), "pattern_distance": detail, "colour_distance": sim.palette_distance("left_palette", "right_palette", policy.palette_least), "texture_raw": cosine_distance(F.col("left_texture"), F.col("right_texture"))})
    return out.drop("left_palette", "right_palette", "left_detail", "right_detail", "left_texture", "right_texture")


def accepted(gated: DataFrame) -> DataFrame:
    """Accepted pairs with rounded distances by signal."""
    return sim.accepted_pairs(gated).withColumns({"detail_distance": F.round("pattern_distance", 7), "colour_distance": F.round("colour_distance", 7), "texture_distance": F.round("texture_raw", 7)})


def long_distances(pairs: DataFrame, scope: str) -> DataFrame:
    own = pairs.where("left_id <> right_id") if scope == "historical" else pairs
    stack = ", ".join(f"'{s}', {s}_distance" for s in sim.SIGNALS)
    return own.select(F.lit(scope).alias("scope"), F.expr(f"stack({len(sim.SIGNALS)}, {stack}) as (signal, distance)"))


class Matching:
    """The lazily built steps of one run, each a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, policy: MatchPolicy = domain.GATES) -> None:
        self.policy = policy
        self.history = domain.history(spark, sf_dir)
        self.upcoming = domain.upcoming(spark, sf_dir)
        self.left = domain.with_vectors(self.upcoming, spark, sf_dir)
        self.right = domain.with_vectors(self.history, spark, sf_dir)

    @lru_cache(maxsize=None)
    def gated(self, scope: str = "serving") -> DataFrame:
        left = self.left if scope == "serving" else self.right
        return settle(sim.gated_pairs(retrieved(left, self.right, self.policy), self.policy), "gated")

    @lru_cache(maxsize=None)
    def pairs(self, scope: str = "serving") -> DataFrame:
        return accepted(self.gated(scope))

    @lru_cache(maxsize=None)
    def calibration(self) -> DataFrame:
        return settle(sim.calibration(long_distances(self.pairs("historical"), "historical").unionByName(long_distances(self.pairs(), "serving"))), "calibration")

    @lru_cache(maxsize=None)
    def scored(self) -> DataFrame:
        return sim.scored_pairs(self.pairs(), sim.serving_calibration(self.calibration(), sim.SIGNALS), self.policy)

    @lru_cache(maxsize=None)
    def ranked(self) -> DataFrame:
        return settle(sim.ranked(self.scored()), "ranked")
