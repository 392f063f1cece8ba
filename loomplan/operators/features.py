"""Catalogue rows to feature tables: historical and upcoming products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.functions.numeric import quality_flags
from loomplan.functions.text import normalize_text


def historical_id(season: Column, product_id: Column) -> Column:
    return F.concat_ws("-", season, product_id)


class NothingLeft(ValueError):
    """A catalogue of which no row can be used."""


def required(rows: DataFrame, message: str) -> DataFrame:
    """``rows``, or an error if there is none; this runs a job that stops at the first row."""
    if rows.isEmpty():
        raise NothingLeft(message)
    return rows


def exclude_zero_sales(rows: DataFrame, sales: str = "sales_qty") -> DataFrame:
    """Rows with sales other than zero; negative ones stay; it is an error if none does."""
    return required(rows.where(F.col(sales) != 0), "no historical row has sales")


def of_known_types(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """Upcoming rows whose item type, normalised, is in the history."""
    types = history.select(normalize_text(F.col("item_type")).alias("_type")).distinct()
    return upcoming.join(types, normalize_text(F.col("item_type")) == F.col("_type"), "left_semi")


def with_history(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """``of_known_types``; it is an error if there is none."""
    return required(of_known_types(upcoming, history), "no upcoming row has an item type of the history")


def without_history(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """The complement of ``with_history``."""
    types = history.select(normalize_text(F.col("item_type")).alias("_type")).distinct()
    return upcoming.join(types, normalize_text(F.col("item_type")) == F.col("_type"), "left_anti")


def historical_features(rows: DataFrame) -> DataFrame:
    """One row for each season and product: the first by ``ordinal``."""
    keyed = rows.withColumn("id", historical_id(F.col("season"), F.col("product_id")))
    first = Window.partitionBy("id").orderBy("ordinal")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def upcoming_features(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Upcoming rows with flags: 'unseen_item' where the history has no such item type."""
    types = history.select(normalize_text(F.col("item_type")).alias("_type")).distinct()
    joined = rows.join(types, normalize_text(F.col("item_type")) == F.col("_type"), "left")
    flags = F.array_compact(F.array(F.when(F.col("_type").isNull(), F.lit("unseen_item"))))
    return joined.withColumn("model_flags", flags).drop("_type")


def image_status(products: DataFrame, images: DataFrame) -> DataFrame:
    """(product_id, status): 'matched', 'missing' or 'unused', by upper-case id."""
    a = products.select(F.upper("product_id").alias("a")).distinct()
    b = images.select(F.upper("stem").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unused").otherwise("matched")
    return both.select(F.coalesce("a", "b").alias("product_id"), status.alias("status"))


def visible(products: DataFrame, has_image: str = "has_image") -> DataFrame:
    """Products with an image, or all where none has one."""
    some = products.agg(F.max(F.col(has_image).cast("int")).alias("m")).select(F.coalesce("m", F.lit(0))).scalar()
    return products.where(F.col(has_image) | (some == 0))


def image_urls(products: DataFrame, images: DataFrame, prefix: str, key: str = "product_id") -> DataFrame:
    """Adds image_url: ``prefix`` and the id where an image of that stem is there, by upper-case id; otherwise null."""
    stems = images.select(F.upper("stem").alias("_stem")).distinct()
    joined = products.join(stems, F.upper(key) == F.col("_stem"), "left")
    return joined.withColumn("image_url", F.when(F.col("_stem").isNotNull(), F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(key)))).drop("_stem")


def missing_images(products: DataFrame) -> DataFrame:
    """(ordinal, id) of the products without an image."""
    return products.where(~F.col("has_image")).select("ordinal", "id")


#: The anomalies that are counted, as quality flags name them.
ANOMALIES = ["dispatch_above_order", "sales_above_dispatch", "sell_through_above_100", "negative_value"]


def dataset_meta(history: DataFrame, upcoming: DataFrame) -> DataFrame:
    """One row: products, image coverage, censored rows and the history's anomalies by kind."""
    flags = quality_flags(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty"), F.col("sell_through"))
    counts = [F.count_if(F.array_contains(flags, a)).alias(a) for a in ANOMALIES]
    a = history.agg(F.count("*").alias("historical_items"), F.count_if("has_image").alias("historical_images"), F.count_if("demand_censored").alias("censored"), *counts)
    b = upcoming.agg(F.count("*").alias("upcoming_items"), F.count_if("has_image").alias("upcoming_images"), F.count_if(~F.col("has_image")).alias("missing_upcoming_images"))
    # One row each.
    return a.join(b, F.lit(True))


@dataclass(frozen=True)
class Source:
    """Features of both catalogues and what is known of them as a whole."""

    history: DataFrame
    upcoming: DataFrame
    meta: DataFrame


def feature_source(historical: DataFrame, upcoming: DataFrame, historical_images: DataFrame, upcoming_images: DataFrame, *, prefix: str = "/images") -> Source:
    """From checked rows of both catalogues and their images (stem) to features and meta.

    historical: season, product_id, item_type, sales_qty, ordinal and more; upcoming: product_id,
    item_type, season, ordinal and more.  History without sales goes, then repeats of a season
    and product but the first; new products of item types that the history doesn't have go.
    Both get id, image_url and has_image, new ones model_flags.  meta: one row of counts,
    and the season of the first new product.  Nothing left on a side is an error.
    """
    sold = exclude_zero_sales(historical)
    history = image_urls(historical_features(sold), historical_images, f"{prefix}/historical")
    known = with_history(upcoming, history)
    fresh = image_urls(upcoming_features(known, history), upcoming_images, f"{prefix}/upcoming").withColumn("id", F.col("product_id"))
    history, fresh = (df.withColumn("has_image", F.col("image_url").isNotNull()) for df in (history, fresh))
    one = lambda df, *columns: df.agg(*columns)
    count = lambda name: F.count("*").alias(name)
    counts = [
        one(historical, count("historical_rows")),
        one(sold, count("_sold")),
        one(history, count("historical_items"), F.count_if("has_image").alias("historical_image_coverage")),
        one(upcoming, count("upcoming_rows")),
        one(fresh, count("upcoming_items"), F.count_if("has_image").alias("upcoming_image_coverage"), F.count_if(F.array_contains("model_flags", "unseen_item")).alias("upcoming_without_historical_item"), F.upper(F.trim(F.min_by("season", "ordinal"))).alias("upcoming_season")),
    ]
    meta = counts[0]
    for c in counts[1:]:
        meta = meta.join(c, F.lit(True))  # one row each
    removed = {"zero_sales_excluded": F.col("historical_rows") - F.col("_sold"), "duplicates_removed": F.col("_sold") - F.col("historical_items"), "unseen_excluded": F.col("upcoming_rows") - F.col("upcoming_items")}
    return Source(history, fresh, meta.withColumns(removed).drop("_sold"))
