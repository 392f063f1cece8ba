"""The published document {meta, historical, upcoming} in parts that tasks write by themselves."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.functions.numeric import quality_flags
from loomplan.sources.commits import put_if_absent


def _named(**columns: Column | str) -> Column:
    """A struct of the given fields in the given order."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def _attributes(df: DataFrame) -> dict[str, Column]:
    """Fields that both catalogues share; what a table doesn't have is null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return {
        "itemType": has("item_type"), "style": has("style_code"), "colourCode": has("colour_code"), "design": has("design"), "categoryType": has("category_type"), "fabric": has("fabric"),
        "season": has("season"), "colour": has("colour"), "imageUrl": has("image_url"), "hasVisualFeature": F.coalesce(F.col("has_image"), F.lit(False)),
    }


def historical_documents(history: DataFrame) -> DataFrame:
    """(ordinal, document) of past products with corrected rates."""
    source = F.col("source_id") if "source_id" in history.columns else F.col("id")
    flags = quality_flags(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty"), F.col("sell_through"))
    document = _named(
        id="id", sourceId=source, **_attributes(history), order="order_qty", dispatch="dispatch_qty", sales="sales_qty", sellThrough=F.round("sell_through", 6), ageingDays="ageing_days",
        weeklySellThrough=F.round("weekly_sell_through", 8), weeklyLogRate="weekly_log_rate", demandCensored="demand_censored", qualityFlags=flags)
    return history.select("ordinal", document.alias("document"))


def upcoming_documents(recommended: DataFrame, matches: DataFrame, minimum: float) -> DataFrame:
    """(ordinal, document) of new products with their recommendation and matches.

    recommended: rows of ``recommend.recommendations``; matches: left_id and its best
    matches in order, as structs.  ``demand`` is null where no forecast was pooled.
    """
    rows = recommended.join(matches.withColumnRenamed("left_id", "_left"), F.col("id") == F.col("_left"), "left").drop("_left")
    skew = F.col("mean_demand") / F.greatest("median_demand", F.lit(1e-6))
    demand = _named(
        weeklyRate=F.round("weekly_rate", 3), horizonWeeks=F.round("horizon_weeks", 1), analoguesUsed="analogues_used", effectiveSampleSize=F.round("effective_n", 2), analogueWeight=F.round("shrinkage_weight", 3),
        priorWeeklyRate=F.round("prior_weekly_rate", 3), censoredAnalogues="censored_analogues", skewRatio=F.round(skew, 3), wideUncertainty="wide_uncertainty", logMu=F.round("log_mu", 6), logSigma=F.round("log_sigma", 6))
    pooled = F.col("pooled")
    recommendation = _named(
        quantity="quantity", low="order_low", high="order_high", expectedSales="expected_sales", salesLow="sales_low", salesHigh="sales_high", matchConfidence="match_confidence", noSuitableMatch="no_match",
        analogueSales="analogue_sales", analogueQuantity="analogue_quantity", targetSellThrough="target_sell_through", minimumVisualScore=F.lit(minimum),
        evidencePolicy=F.when(pooled, F.lit("pooled_visual_analogue_forecast")).otherwise(F.lit("single_top_visual_analogue")), topMatchScore=F.round(F.coalesce("best_score", F.lit(0.0)), 4),
        quantityCapped="quantity_capped", highCapped="high_capped", buyCeiling="buy_ceiling", demand=F.when(pooled, demand))
    kind = lambda m: F.struct(m["historical_id"].alias("historicalId"), m["visual_score"].alias("visualScore"), m["hybrid_score"].alias("hybridScore"))
    first = F.try_element_at("matches", F.lit(1))
    added = F.array(F.when(first.isNotNull() & first["visual_score"].isNull(), F.lit("missing_image")), F.when(F.col("no_match"), F.lit("no_suitable_match")))
    flags = F.array_distinct(F.array_compact(F.concat(F.coalesce("model_flags", F.array().cast("array<string>")), added)))
    document = _named(id="id", **_attributes(rows), modelFlags=flags, recommendation=recommendation, matches=F.coalesce(F.transform("matches", kind), F.array()))
    return rows.select("ordinal", document.alias("document"))


def write_artifact(meta: DataFrame, historical: DataFrame, upcoming: DataFrame, path: str, *, parts: int | None = None) -> dict[str, int]:
    """Write the document under ``path``: lines of JSON in parts by ranges of ordinal, and last a manifest.

    meta: one row; historical, upcoming: ordinal, document.  Each task writes what it
    holds, in so many ``parts`` or as many as their size makes.  The manifest names the parts in order with their numbers of lines, and is put
    once: a path without one holds no document, a path with one is never written again.
    """
    spark = meta.sparkSession
    sections: dict[str, list[dict]] = {}
    for name, rows in (("historical", historical), ("upcoming", upcoming)):
        dealt = (rows.repartitionByRange(parts, "ordinal") if parts else rows.repartitionByRange("ordinal")).sortWithinPartitions("ordinal")
        dealt.select(F.to_json("document", {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/{name}")
        written = spark.read.text(f"{path}/{name}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part")).count().orderBy("part")
        sections[name] = [{"part": r["part"], "lines": r["count"]} for r in written.collect()]
    meta.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(f"{path}/meta")
    if not put_if_absent(spark, f"{path}/manifest.json", json.dumps(sections, sort_keys=True)):
        raise ValueError(f"{path} holds a document already")
    return {name: sum(p["lines"] for p in parts) for name, parts in sections.items()}


def read_artifact(spark: SparkSession, path: str, section: str, like: DataFrame | None = None) -> DataFrame:
    """A section's lines, or with ``like`` (a DataFrame with ``document``) the documents parsed to its schema."""
    lines = spark.read.text(f"{path}/{section}")
    return lines if like is None else lines.select(F.from_json("value", like.schema["document"].dataType).alias("document"))
