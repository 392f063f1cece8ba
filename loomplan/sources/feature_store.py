"""Image features kept between runs: only images that the cache doesn't know are encoded."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.operators.images import batch_embed
from loomplan.sources.commits import commit, entries
from loomplan.sources.publish import cache_key, cache_misses
from loomplan.sources.stage import settle

CACHE = "cache_key string, vector array<float>, pattern array<float>"


@dataclass(frozen=True)
class Model:
    """What features depend on besides the image: encoders with their revisions, and the preparation of pictures."""

    name: str
    revision: str
    preprocessing: str
    dimension: int


@dataclass(frozen=True)
class Refreshed:
    """features: id, vector, pattern, reused (from the cache); issues: id, checksum, issue; cache: the old rows and the new."""

    features: DataFrame
    issues: DataFrame
    fresh: DataFrame
    cache: DataFrame


def refresh(images: DataFrame, cache: DataFrame, model: Model, decode: Callable[[bytes], np.ndarray], encoder: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], *, batch_size: int = 16) -> Refreshed:
    """Features of all ``images`` (id, item_type, content), with the encoder run over those missing in ``cache`` only.

    Products that show one image share one row of the cache.  A picture that can't be used
    gives an issue for each product that shows it and no features; it isn't kept, so the
    next run tries it again.  One image with two item types is an error, before anything
    is encoded.  A null item type counts as a blank one, null content as an empty picture.
    Bytes of images travel only for those that are encoded.  A null id is a product like
    others; no images give empty results.
    """
    key = cache_key(F.col("checksum"), F.col("item_type"), F.lit(model.name), F.lit(model.revision), F.lit(model.preprocessing))
    named = images.select("id", F.coalesce("item_type", F.lit("")).alias("item_type"), F.coalesce("content", F.lit(b"")).alias("content"))
    named = named.withColumn("checksum", F.sha2("content", 256)).withColumn("cache_key", key)
    asked = settle(named.select("id", "item_type", "checksum", "cache_key", (F.length("content") == 0).alias("empty")), "wanted-features")
    wanted, named = asked.where("not empty"), named.where(F.length("content") > 0)
    twice = wanted.groupBy("checksum").agg(F.min("item_type").alias("a"), F.max("item_type").alias("b")).where("a <> b").first()
    if twice:
        raise ValueError(f"one image has two item types: {twice['a']} and {twice['b']}")
    keys = wanted.select("cache_key", "checksum").distinct()
    misses = settle(cache_misses(keys, cache), "feature-misses")
    encoded = batch_embed(named.join(misses.select("cache_key"), "cache_key", "left_semi"), decode, encoder, dimension=model.dimension, batch_size=batch_size)
    fresh = settle(encoded.withColumn("cache_key", key), "fresh-features")
    columns = ["cache_key", "vector", "pattern"]
    good = fresh.where("issue is null").select(*columns)
    known = cache.select(*columns).withColumn("reused", F.lit(True)).unionByName(good.withColumn("reused", F.lit(False)))
    features = wanted.join(known, "cache_key").select("id", "vector", "pattern", "reused")
    issues = wanted.join(fresh.where("issue is not null").select("cache_key", "issue"), "cache_key").select("id", "checksum", "issue")
    issues = issues.unionByName(asked.where("empty").select("id", "checksum", F.lit("empty").alias("issue")))
    return Refreshed(features, issues, good, known.drop("reused"))


class FeatureStore:
    """A cache of features under ``root``: parts that only grow, named by a log that each run adds one entry to.

    A run that fails leaves no entry, so nothing of it is seen.  Runs at the same time may
    encode one image twice; both rows are equal and readers take one.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def cache(self) -> DataFrame:
        """The rows of all parts that are committed, one for each key."""
        parts = [e["part"] for _, e in entries(self.spark, self.root)]
        if not parts:
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.schema(CACHE).parquet(*[f"{self.root}/{p}" for p in parts]).dropDuplicates(["cache_key"])

    def refresh(self, images: DataFrame, model: Model, decode, encoder, *, batch_size: int = 16) -> Refreshed:
        """``refresh`` against the store, whose new rows are written and committed before the features are handed out."""
        out = refresh(images, self.cache(), model, decode, encoder, batch_size=batch_size)
        if not out.fresh.isEmpty():
            part = f"part={uuid.uuid4().hex}"
            out.fresh.write.parquet(f"{self.root}/{part}")
            commit(self.spark, self.root, lambda before: {"part": part})
        return out
