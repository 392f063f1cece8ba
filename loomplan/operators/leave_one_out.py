"""Forecasts of past products by a model that each time is fitted without the product itself.

Nothing is fitted again: a product is taken out of the moments (number, mean, sum of squared
deviations of log rates) of its category, its item type and the whole in closed form, and
out of the spread of category means that the weight of the prior comes from.  Without it
the horizon is one of three values, and moments are made for each of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomplan.functions.numeric import clamp, lognormal_conditional_mean
from loomplan.operators import seasons
from loomplan.operators.demand import UNNAMED, pooled_demand, told_weeks
from loomplan.operators.quantiles import exact_percentiles
from loomplan.policy import DEMAND, DemandPolicy
from loomplan.sources.stage import settle

LEVELS = {"c": ["item_type", "category_type"], "t": ["item_type"], "g": []}


def _without(n: Column, mean: Column, m2: Column, y: Column) -> tuple[Column, Column, Column]:
    """The moments of a group without ``y``; as they are where y is null, and null where nothing is left."""
    left = F.when(n > 1, n - 1)
    other = mean - (y - mean) / left
    rest = F.greatest(m2 - (y - mean) * (y - other), F.lit(0.0))
    out = F.when(y.isNull(), n).otherwise(left), F.when(y.isNull(), mean).otherwise(other), F.when(y.isNull(), m2).otherwise(rest)
    return out


def _sigma(n: Column, m2: Column, policy: DemandPolicy) -> Column:
    floor = F.lit(policy.minimum_log_sigma)
    return F.greatest(F.coalesce(F.sqrt(m2 / F.when(n > 1, n - 1)), floor), floor)


def _horizons(history: DataFrame, policy: DemandPolicy) -> tuple[float, float, float, float]:
    """(all, mark, over, under): the upper median of all weeks, and without one: ``over`` for weeks up to ``mark``, ``under`` for longer ones."""
    weeks = told_weeks(history, policy)
    n, back = weeks.count(), policy.fallback_horizon_weeks
    if not n:
        return back, back, back, back
    k = (n - 1) // 2
    ranks = [n // 2, k, min(k + 1, n - 1)]
    # A rank as a share that rounding can't move to another one.
    got = exact_percentiles(weeks.withColumn("of", F.lit("weeks")), ["of"], "w", [(r + 0.5) / n for r in ranks], upper=True).first()["q"]
    return (got[0], back, back, back) if n == 1 else (got[0], got[1], got[2], got[1])


def folds(history: DataFrame, policy: DemandPolicy = DEMAND) -> tuple[DataFrame, DataFrame]:
    """Rows with what taking each out means, and the moments of all groups under each horizon.

    Rows: id, item_type, category_type (blank: UNSPECIFIED), cleaned_sales, weeks (null where a row
    doesn't tell), censored, h (the horizon without it) and y (its log rate under h; null for
    a row that priors don't use).
    """
    whole, mark, over, under = _horizons(history, policy)
    rows = seasons.prepared(history, policy)
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(UNNAMED)).otherwise(F.col(c)).alias(c)
    told = (F.coalesce(F.col("ageing_days").cast("double"), F.lit(0.0)) > 0) | (F.coalesce(F.col("weekly_sell_through").cast("double"), F.lit(0.0)) > 0)
    own = F.coalesce("weeks", F.greatest(F.lit(policy.fallback_horizon_weeks), F.lit(1.0)))
    h = F.when(~told, F.lit(whole)).when(own > mark, F.lit(under)).otherwise(F.lit(over))
    rows = rows.withColumn("h", h).withColumn("on_floor", F.coalesce("weeks", F.greatest("h", F.lit(1.0))))
    y = F.when(~F.col("censored") & (F.col("cleaned_sales") > 0), F.log(F.col("cleaned_sales") / F.col("on_floor")))
    rows = settle(rows.select("id", named("item_type"), named("category_type"), "cleaned_sales", "weeks", "censored", "h", y.alias("y")), "folds")
    statistics = settle(seasons.season_statistics(history, policy), "statistics").where("kind in ('told', 'fallback')")
    spread = None
    for value in sorted({whole, over, under}):
        away = F.when(F.col("kind") == "fallback", F.log(F.lit(max(value, 1.0)))).otherwise(F.lit(0.0))
        leaves = seasons.pooled(statistics.select("item_type", "category_type", "n", (F.col("mean") - away).alias("mean"), "m2"), LEVELS["c"]).withColumn("h", F.lit(value))
        spread = leaves if spread is None else spread.unionByName(leaves)
    return rows, settle(spread, "moments")


def _moments(leaves: DataFrame, tag: str) -> DataFrame:
    """Moments of one level under each horizon: h, the level's keys (prefixed by the tag), and a struct."""
    keys = ["h", *LEVELS[tag]]
    got = leaves if tag == "c" else seasons.pooled(leaves, keys)
    return got.select(*[F.col(k).alias(f"_{tag}_{k}") for k in keys], F.struct("n", "mean", "m2").alias(f"_{tag}"))


def fold_priors(rows: DataFrame, leaves: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """Adds fold_mu and fold_sigma: the prior of (item_type, category_type) in a fold.

    rows: h, item_type, category_type, and of the row that is taken out out_type, out_category
    and out_y.  Each level is drawn to the one above by its rows, as ``demand.shrunk_priors`` does.
    """
    out = rows
    for tag, keys in LEVELS.items():
        table = _moments(leaves, tag)
        out = out.join(table, (F.col("h") == F.col(f"_{tag}_h")) & F.expr(" and ".join([f"{k} = _{tag}_{k}" for k in keys]) or "true"), "left").drop(*[f"_{tag}_{k}" for k in ["h", *keys]])
    same_type = F.col("item_type") == F.col("out_type")
    same = {"g": F.lit(True), "t": same_type, "c": same_type & (F.col("category_type") == F.col("out_category"))}
    mu = sigma = None
    for tag in ("g", "t", "c"):
        n, mean, m2 = _without(F.col(f"_{tag}.n"), F.col(f"_{tag}.mean"), F.col(f"_{tag}.m2"), F.when(same[tag], F.col("out_y")))
        out = out.withColumns({f"_n{tag}": n, f"_mu{tag}": mean, f"_s{tag}": _sigma(n, m2, policy)})
        if mu is None:
            mu, sigma = F.col("_mug"), F.col("_sg")
            continue
        w = F.col(f"_n{tag}") / (F.col(f"_n{tag}") + policy.group_shrinkage_rows)
        there = F.col(f"_n{tag}").isNotNull()
        out = out.withColumns({f"_mu{tag}": F.when(there, w * F.col(f"_mu{tag}") + (1 - w) * mu).otherwise(mu), f"_s{tag}": F.when(there, F.sqrt(w * F.col(f"_s{tag}") * F.col(f"_s{tag}") + (1 - w) * sigma * sigma)).otherwise(sigma)})
        mu, sigma = F.col(f"_mu{tag}"), F.col(f"_s{tag}")
    return out.withColumns({"fold_mu": mu, "fold_sigma": sigma}).drop(*[f"_{x}{tag}" for tag in LEVELS for x in ("", "n", "mu", "s")])


def fold_tau(rows: DataFrame, leaves: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """Adds fold_tau: how many analogues weigh as much as the prior, without each row."""
    enough = lambda n: n >= policy.group_shrinkage_rows
    own = leaves.select("h", "item_type", "category_type", F.struct("n", "mean", "m2").alias("_c"))
    counted = leaves.where(enough(F.col("n"))).select("h", F.lit(1).alias("n"), "mean", F.lit(0.0).alias("m2"), _sigma(F.col("n"), F.col("m2"), policy).alias("s"))
    whole = seasons.pooled(counted, ["h"]).join(counted.groupBy("h").agg(F.sum(F.col("s") * F.col("s")).alias("within")), "h").select(F.col("h").alias("_h"), F.struct("n", "mean", "m2", "within").alias("_w"))
    out = rows.join(own, ["h", "item_type", "category_type"], "left").join(whole, F.col("h") == F.col("_h"), "left").drop("_h")
    was = F.when(enough(F.col("_c.n")), F.col("_c.mean"))
    n, mean, m2 = _without(F.col("_c.n"), F.col("_c.mean"), F.col("_c.m2"), F.col("y"))
    now = enough(n)
    # Out with the category as it was, in with what is left of it.
    k, centre, off = _without(F.col("_w.n"), F.col("_w.mean"), F.col("_w.m2"), was)
    k, centre, off = F.coalesce(k, F.lit(0)), F.coalesce(centre, F.lit(0.0)), F.coalesce(off, F.lit(0.0))
    within = F.coalesce("_w.within", F.lit(0.0)) - F.when(was.isNotNull(), F.pow(_sigma(F.col("_c.n"), F.col("_c.m2"), policy), F.lit(2.0))).otherwise(F.lit(0.0))
    out = out.withColumns({"_k": k, "_centre": centre, "_off": off, "_within": within, "_n": F.when(now, n), "_mean": mean, "_s": _sigma(n, m2, policy)})
    added = F.col("_n").isNotNull()
    groups = F.col("_k") + F.when(added, 1).otherwise(0)
    step = F.col("_mean") - F.col("_centre")
    spread = F.col("_off") + F.when(added, step * step * F.col("_k") / (F.col("_k") + 1)).otherwise(F.lit(0.0))
    inner = (F.col("_within") + F.when(added, F.col("_s") * F.col("_s")).otherwise(F.lit(0.0))) / groups
    between = spread / F.when(groups > 1, groups - 1)
    ratio = clamp(inner / F.when(between > 1e-9, between), 0.5, 20.0)
    tau = F.when(groups < 2, F.lit(4.0)).otherwise(F.coalesce(ratio, F.lit(20.0)))
    return out.withColumn("fold_tau", tau).drop("_c", "_w", "_k", "_centre", "_off", "_within", "_n", "_mean", "_s")


def refitted_forecasts(history: DataFrame, accepted: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """A forecast of each product that has analogues, by a model fitted without it; with its cleaned_sales.

    accepted: left_id, right_id, visual_score and match_rank of matches among the history, none
    of a product with itself.  Horizon, priors, their weight and the correction of sold-out
    analogues are all those of the fold.
    """
    rows, leaves = folds(history, policy)
    taken = lambda df: df.withColumns({"out_type": F.col("item_type"), "out_category": F.col("category_type"), "out_y": F.col("y")})
    wanted = rows.join(accepted.select(F.col("left_id").alias("id")).distinct(), "id", "left_semi")
    products = settle(fold_tau(fold_priors(taken(wanted), leaves, policy), leaves, policy), "fold-models")

    fold = wanted.select(F.col("id").alias("left_id"), "h", F.col("item_type").alias("out_type"), F.col("category_type").alias("out_category"), F.col("y").alias("out_y"))
    facts = rows.select(F.col("id").alias("right_id"), "item_type", "category_type", "cleaned_sales", "weeks", "censored")
    pairs = fold_priors(accepted.join(fold, "left_id").join(facts, "right_id"), leaves, policy)
    pairs = pairs.withColumn("rate", F.col("cleaned_sales") / F.coalesce("weeks", F.greatest("h", F.lit(1.0))))
    lifted = F.col("censored") & (F.col("rate") > 0)
    pairs = pairs.withColumn("demand_censored", lifted).withColumn("corrected_rate", F.when(lifted, lognormal_conditional_mean(F.col("fold_mu"), F.col("fold_sigma"), F.col("rate"))).otherwise(F.col("rate")))
    # In a fold every analogue has its own rate, and every product is a group of its own.
    pairs = settle(pairs.withColumn("pair", F.concat_ws("\x1f", "left_id", "right_id")), "fold-analogues")
    rates = pairs.select(F.col("pair").alias("id"), "corrected_rate", "demand_censored")
    near = pairs.select("left_id", F.col("pair").alias("right_id"), "visual_score", "match_rank")
    none = F.lit(None).cast("string")
    priors = products.select(F.lit("itemType").alias("level"), F.col("id").alias("item_type"), none.alias("category_type"), F.col("fold_mu").alias("mu"), F.col("fold_sigma").alias("sigma"))
    priors = priors.unionByName(history.sparkSession.createDataFrame([("global", None, None, 0.0, 1.0)], "level string, item_type string, category_type string, mu double, sigma double"))
    asked = products.select("id", F.col("id").alias("item_type"), F.lit("").alias("category_type"), F.col("h").alias("fold_horizon"), "fold_tau", "cleaned_sales")
    return pooled_demand(asked, near, rates, priors, F.col("fold_tau"), F.col("fold_horizon"), policy).drop("item_type", "category_type")


def backtest(forecasts: DataFrame) -> DataFrame:
    """One row: products, wmape, bias and coverage of forecasts with cleaned_sales."""
    error = F.col("point_demand") - F.col("cleaned_sales")
    inside = (F.col("cleaned_sales") >= F.col("p10")) & (F.col("cleaned_sales") <= F.col("p90"))
    return forecasts.agg(F.count("*").alias("products"), (F.sum(F.abs(error)) / F.sum("cleaned_sales")).alias("wmape"), F.avg(error).alias("bias"), F.avg(inside.cast("double")).alias("coverage"))
