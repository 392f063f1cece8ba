"""Order recommendations, what-if decisions and the planner's views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.functions.numeric import P10_Z, clamp, cleaned_sales, match_confidence, newsvendor_z, no_suitable_match, quality_flags, round_pack, shown_percent
from loomplan.functions.text import safe_cell
from loomplan.operators.demand import pooled_demand, with_ceiling
from loomplan.policy import DEMAND, MATCH, DemandPolicy, MatchPolicy


def accepted_analogues(ranked: DataFrame, minimum: float = MATCH.minimum_score) -> DataFrame:
    """Matches whose shown score reaches the shown minimum."""
    return ranked.where(F.col("visual_score").isNotNull() & (shown_percent(F.col("visual_score")) >= shown_percent(minimum)))


def top_matches(upcoming: DataFrame, ranked: DataFrame, history: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """Upcoming products with their best match, its figures, match_confidence and no_match."""
    best = ranked.where("match_rank = 1").select("left_id", F.col("right_id").alias("best_id"), F.col("visual_score").alias("best_score"), F.col("hybrid_score").alias("best_hybrid"))
    facts = history.select(
        F.col("id").alias("_id"), F.greatest(F.coalesce(F.col("order_qty").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("best_order"),
        cleaned_sales(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty")).alias("best_sales"),
        F.size(quality_flags(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty"), F.col("sell_through"))).alias("best_issues"))
    out = upcoming.join(best, F.col("id") == F.col("left_id"), "left").drop("left_id").join(facts, F.col("best_id") == F.col("_id"), "left").drop("_id")
    confidence = match_confidence(F.col("best_hybrid"), F.col("best_score").isNotNull(), F.coalesce("best_issues", F.lit(0)), policy.minimum_score, policy.high_score)
    out = out.withColumn("match_confidence", confidence)
    return out.withColumn("no_match", no_suitable_match(F.col("best_score"), F.col("match_confidence"), policy.minimum_score) | F.col("best_order").isNull())


def _held(value: Column, ceiling: Column) -> Column:
    return clamp(value, 0, ceiling).cast("long")


def recommend(products: DataFrame, *, target: Column | float = DEMAND.target_sell_through, policy: DemandPolicy = DEMAND) -> DataFrame:
    """The recommendation columns for products of ``top_matches`` with ceiling and forecast columns.

    Where there is no forecast (log_mu null) the best analogue's sales are divided by
    the target; where there is no match every quantity is 0.  One solve serves the
    quantity and both ends of its band.
    """
    goal = target if isinstance(target, Column) else F.lit(float(target))
    pack = lambda c: round_pack(c, policy.pack)
    out = products.withColumn("buy_ceiling", F.rint("ceiling").cast("long")).withColumn("_goal", goal)
    ceiling, s, mu = F.col("buy_ceiling"), F.col("log_sigma"), F.col("log_mu")
    out = out.withColumn("_z", F.when(mu.isNotNull() & ~F.col("no_match"), newsvendor_z(s, F.col("_goal"))))
    solved = F.exp(mu + s * F.col("_z"))
    band = F.exp(P10_Z * s)
    held_goal = F.greatest(F.col("_goal"), F.lit(0.01))
    out = out.withColumns({
        "pooled": mu.isNotNull() & ~F.col("no_match"), "analogue_sales": F.when(F.col("no_match"), F.lit(0)).otherwise(F.greatest(pack(F.col("best_sales")), F.lit(0))).cast("long"),
        "_raw": pack(solved), "_raw_low": pack(solved / band), "_raw_high": pack(solved * band),
    })
    single = pack(F.col("analogue_sales") / held_goal)
    pick = lambda pooled, alone, none=0: F.when(F.col("no_match"), F.lit(none)).when(F.col("pooled"), pooled).otherwise(alone)
    skew = F.col("mean_demand") / F.greatest("median_demand", F.lit(1e-6))
    return out.withColumns({
        "quantity": pick(_held(F.col("_raw"), ceiling), _held(single, ceiling)).cast("long"),
        "order_low": pick(_held(F.col("_raw_low"), ceiling), _held(single, ceiling)).cast("long"),
        "order_high": pick(_held(F.col("_raw_high"), ceiling), _held(single, ceiling)).cast("long"),
        "expected_sales": pick(_held(pack(F.col("point_demand")), ceiling), F.col("analogue_sales")).cast("long"),
        "sales_low": pick(_held(pack(F.col("p10")), ceiling), F.col("analogue_sales")).cast("long"),
        "sales_high": pick(_held(pack(F.col("p90")), ceiling), F.col("analogue_sales")).cast("long"),
        "quantity_capped": pick(F.col("_raw") > ceiling, single > ceiling, False), "high_capped": pick(F.col("_raw_high") > ceiling, single > ceiling, False),
        "analogue_quantity": F.coalesce(F.greatest(pack(F.col("best_order")), F.lit(0)), F.lit(0)).cast("long"),
        "wide_uncertainty": F.when(F.col("pooled"), (F.col("effective_n") < policy.wide_effective_n) | (skew >= policy.wide_skew_ratio)),
        "target_sell_through": F.col("_goal"),
    }).drop("_goal", "_z", "_raw", "_raw_low", "_raw_high")


def recommendations(upcoming: DataFrame, ranked: DataFrame, fitted: Mapping[str, DataFrame], *, target: float = DEMAND.target_sell_through, match: MatchPolicy = MATCH, policy: DemandPolicy = DEMAND) -> DataFrame:
    """From ranked matches and a fitted demand model to one recommendation for each product."""
    base = with_ceiling(top_matches(upcoming, ranked, fitted["history"], match), fitted["ceilings"])
    accepted = accepted_analogues(ranked, match.minimum_score)
    forecast = pooled_demand(upcoming.select("id", "item_type", "category_type"), accepted, fitted["history"], fitted["priors"], fitted["tau"].scalar(), fitted["horizon"].scalar(), policy)
    return recommend(base.join(forecast.drop("item_type", "category_type"), "id", "left"), target=target, policy=policy)


NO_FORECAST = ["log_mu", "log_sigma", "mean_demand", "median_demand", "point_demand", "p10", "p90", "effective_n"]


def single_analogue(upcoming: DataFrame, ranked: DataFrame, history: DataFrame, *, target: float = DEMAND.target_sell_through, match: MatchPolicy = MATCH, policy: DemandPolicy = DEMAND) -> DataFrame:
    """The rule without a fitted model: the best analogue's sales over the target, under the flat ceiling."""
    base = top_matches(upcoming, ranked, history, match).withColumn("ceiling", F.lit(float(policy.flat_ceiling)))
    return recommend(base.withColumns({c: F.lit(None).cast("double") for c in NO_FORECAST}), target=target, policy=policy)


#: Settings that one call of ``what_if`` takes: each meets every product.
MOST_SETTINGS = 1_000


def what_if(published: DataFrame, settings: DataFrame, history: DataFrame, priors: DataFrame, ceilings: DataFrame, tau: Column, horizon: Column, *, chosen: DataFrame | None = None, match: MatchPolicy = MATCH, policy: DemandPolicy = DEMAND) -> DataFrame:
    """Decisions for each setting (minimum, target) from published matches alone.

    published: id, item_type, category_type, matches (the published array of structs);
    settings: setting_id, minimum, target; history: id, item_type, has_image and the
    published weekly_log_rate.  Only published matches of the same item type with an image
    count.  Of those that reach the minimum the one that ``chosen`` (id, historical_id)
    names leads, otherwise the first; the forecast pools all of them.  Every product meets
    every setting, so more than ``MOST_SETTINGS`` are an error.
    """
    if settings.limit(MOST_SETTINGS + 1).count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    long = published.select("id", "item_type", "category_type", F.explode_outer("matches").alias("m"))
    facts = history.select(F.col("id").alias("right_id"), F.col("item_type").alias("_type"), "has_image", "order_qty", "dispatch_qty", "sales_qty", "sell_through", "weekly_log_rate", "demand_censored")
    joined = long.join(facts, F.col("m.historical_id") == F.col("right_id"), "left")
    joined = joined.where(F.col("m").isNotNull() & (F.col("item_type") == F.col("_type")) & F.col("has_image"))
    if chosen is None:
        joined = joined.withColumn("_chosen", F.lit(False))
    else:
        picks = chosen.select(F.col("id").alias("_of"), F.col("historical_id").alias("_pick")).dropDuplicates(["_of"])
        joined = joined.join(picks, F.col("id") == F.col("_of"), "left").withColumn("_chosen", F.col("_pick").eqNullSafe(F.col("right_id"))).drop("_of", "_pick")
    grid = joined.join(F.broadcast(settings), shown_percent(F.coalesce("m.visual_score", F.lit(0.0))) >= shown_percent(F.col("minimum")))
    key = F.concat_ws("|", F.col("id"), F.col("setting_id").cast("string"))
    grid = grid.withColumn("key", key)
    grid = grid.withColumn("match_rank", F.row_number().over(Window.partitionBy("key").orderBy("m.match_rank")))
    products = published.select("id", "item_type", "category_type").join(F.broadcast(settings), F.lit(True)).withColumn("product", F.col("id")).withColumn("id", key)
    accepted = grid.select(F.col("key").alias("left_id"), "right_id", F.col("m.visual_score").alias("visual_score"), "match_rank")
    rates = history.select("id", F.exp("weekly_log_rate").alias("corrected_rate"), "demand_censored")
    forecast = pooled_demand(products.select("id", "item_type", "category_type"), accepted, rates, priors, tau, horizon, policy)
    # The chosen match, where it is eligible, otherwise the best.
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_chosen"), "match_rank"))
    issues = F.size(quality_flags(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty"), F.col("sell_through")))
    lead = grid.withColumn("_first", first).where("_first = 1").select(
        F.col("key").alias("_id"), F.col("right_id").alias("best_id"), F.col("m.visual_score").alias("best_score"), issues.alias("best_issues"),
        F.greatest(F.coalesce(F.col("order_qty").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("best_order"),
        cleaned_sales(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty")).alias("best_sales"))
    base = with_ceiling(products.join(lead, F.col("id") == F.col("_id"), "left").drop("_id"), ceilings)
    score = F.coalesce("best_score", F.lit(0.0))
    shown = F.col("best_score").isNotNull() & (shown_percent(score) >= shown_percent(F.col("minimum")))
    confidence = F.when(F.col("best_score").isNotNull() & (score >= match.high_score) & (F.col("best_issues") == 0), F.lit("High")).when(shown, F.lit("Medium")).otherwise(F.lit("Low"))
    base = base.withColumn("match_confidence", confidence).withColumn("no_match", ~shown)
    out = recommend(base.join(forecast.drop("item_type", "category_type"), "id", "left"), target=F.col("target"), policy=policy)
    return out.withColumn("id", F.col("product")).drop("product", "minimum")


def planner_state(log: DataFrame) -> DataFrame:
    """(plan_id, id, override_quantity, approved) that still hold, from a log of a planner's steps.

    log: plan_id, seq, kind, id, quantity.  A change of settings clears all of a plan;
    choosing an analogue, or a reset, clears the product's override and approval; an
    override clears its approval.  Products with neither have no row.
    """
    settings = log.groupBy("plan_id").agg(last_step("settings").alias("cleared"))
    own = log.where(F.col("kind").isin("override", "choose", "reset", "approve")).groupBy("plan_id", "id").agg(*last_steps())
    return standing(own.join(settings, "plan_id"))


def last_step(*kinds: str) -> Column:
    """The greatest seq of a group's steps of these kinds, -1 without any."""
    return F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("seq"))), F.lit(-1))


def last_steps() -> list[Column]:
    """Of a product's steps: the last override and its quantity, the last that undid one, the last approval."""
    quantity = F.max_by("quantity", F.when(F.col("kind") == "override", F.col("seq")))
    return [last_step("override").alias("overridden"), last_step("choose", "reset").alias("undone"), last_step("approve").alias("approved_at"), quantity.alias("quantity")]


def standing(products: DataFrame) -> DataFrame:
    """Overrides and approvals that hold, from ``last_steps`` of each product and when its plan was last cleared."""
    holds = (F.col("overridden") > F.col("undone")) & (F.col("overridden") > F.col("cleared"))
    approved = F.col("approved_at") > F.greatest("overridden", "undone", "cleared")
    out = products.select("plan_id", "id", F.when(holds, F.col("quantity")).alias("override_quantity"), approved.alias("approved"))
    return out.where(F.col("override_quantity").isNotNull() | F.col("approved"))


def planner_rows(decisions: DataFrame, overrides: DataFrame, approvals: DataFrame) -> DataFrame:
    """Decisions with final_quantity (an override counts first) and approved (an override clears it).

    overrides: id, override_quantity; approvals: id.
    """
    joined = decisions.join(overrides, "id", "left").join(approvals.select("id", F.lit(True).alias("_approved")), "id", "left")
    return joined.withColumns({
        "final_quantity": F.coalesce("override_quantity", "quantity"),
        "approved": F.coalesce("_approved", F.lit(False)) & F.col("override_quantity").isNull(),
    }).drop("_approved")


def sales_from_order(order: Column, point: Column, low: Column, high: Column, pooled: Column) -> dict[str, Column]:
    """Sales that an order allows: a forecast is held to the order; demand beyond it is flagged."""
    cut = lambda v: F.when(pooled, F.least(v, order)).otherwise(v)
    return {"sales": cut(point), "sales_from": cut(low), "sales_to": cut(high), "demand_over_order": pooled & (point > order)}


def planner_export(rows: DataFrame) -> DataFrame:
    """The planner's 21 columns of ``planner_rows`` that also have colour_score, pattern_score, style_score and texture_score.

    Scores are whole percents, null where there is no match or no such signal; the final
    order is the override's quantity where there is one.
    """
    matched = ~F.col("no_match")
    percent = lambda c: F.when(matched, shown_percent(F.col(c)).cast("long"))
    sales = sales_from_order(F.col("final_quantity"), F.col("expected_sales"), F.col("sales_low"), F.col("sales_high"), F.col("pooled"))["sales"]
    yes = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    return rows.select(
        safe_cell(F.col("id")).alias("product_id"), safe_cell(F.col("item_type")).alias("product_type"), safe_cell(F.col("design")).alias("design"), safe_cell(F.col("colour")).alias("colour"), safe_cell(F.col("category_type")).alias("category"),
        yes(matched, "Matched", "No product match").alias("match_status"), F.when(matched, F.col("best_id")).alias("similar_past_product"), percent("best_score").alias("overall_similarity"),
        percent("colour_score").alias("colour_similarity"), percent("pattern_score").alias("pattern_similarity"), percent("style_score").alias("style_similarity"), percent("texture_score").alias("texture_similarity"),
        "match_confidence", sales.alias("expected_sales"), F.col("analogue_sales").alias("past_product_sales"), F.when(matched, F.col("analogue_quantity")).otherwise(F.lit(0)).alias("past_product_order"),
        F.col("quantity").alias("recommended_order"), F.col("buy_ceiling").alias("maximum_order"), yes(F.col("quantity_capped"), "Yes", "No").alias("order_limit_applied"),
        F.col("final_quantity").alias("final_order"), yes(F.col("approved"), "Approved", "Pending").alias("approval_status"))


def portfolio_kpis(rows: DataFrame) -> DataFrame:
    """One row over ``planner_rows``: products, image coverage, matched ones, total order and approvals."""
    coverage = F.round(F.avg(F.col("has_image").cast("double")), 4)
    return rows.agg(F.count("*").alias("styles"), coverage.alias("coverage"), F.count_if(~F.col("no_match")).alias("decided"), F.sum("final_quantity").alias("total_order"), F.count_if("approved").alias("approved"))


def portfolio_search(rows: DataFrame, text: str = "", *, item_type: str | Column | None = None, confidence: str | None = None) -> DataFrame:
    """Rows whose id, design, colour, category or fabric hold ``text`` in any case, of one item type and confidence where given."""
    wanted = text.strip().upper()
    out = rows
    if wanted:
        out = out.where(F.upper(F.concat_ws(" ", "id", "design", "colour", "category_type", "fabric")).contains(wanted))
    if item_type is not None:
        out = out.where(F.col("item_type") == item_type)
    return out if confidence is None else out.where(F.col("match_confidence") == confidence)
