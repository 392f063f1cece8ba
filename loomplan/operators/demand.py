"""The demand model: rate priors with hierarchical shrinkage, censoring, pooled forecasts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.functions.numeric import P10_Z, clamp, cleaned_sales, is_censored, lognormal_conditional_mean, weeks_on_floor
from loomplan.operators.quantiles import exact_percentiles
from loomplan.policy import DEMAND, DemandPolicy
from loomplan.sources.stage import settle

UNNAMED = "UNSPECIFIED"


def _named(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(UNNAMED)).otherwise(F.col(column))


def told_weeks(history: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """(w) of the rows that say something of their weeks on floor."""
    days, weekly = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("ageing_days", "weekly_sell_through"))
    weeks = weeks_on_floor(F.col("ageing_days"), F.col("sell_through"), F.col("weekly_sell_through"), policy.fallback_horizon_weeks)
    return history.where((days > 0) | (weekly > 0)).select(weeks.alias("w"))


def upper_median(counts: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """One row, horizon_weeks: the upper median of weeks ``w`` that ``n`` rows have each, or the fallback without any."""
    found = exact_percentiles(counts.withColumn("of", F.lit("weeks")), ["of"], "w", [0.5], weight="n", upper=True)
    return found.agg(F.coalesce(F.max(F.get("q", F.lit(0))), F.lit(policy.fallback_horizon_weeks)).alias("horizon_weeks"))


def horizon_weeks(history: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """One row: the upper median of the weeks on floor of rows that tell them."""
    return upper_median(told_weeks(history, policy).groupBy("w").agg(F.count("*").alias("n")), policy)


def with_rates(history: DataFrame, policy: DemandPolicy = DEMAND, horizon: Column | None = None) -> DataFrame:
    """Adds cleaned_sales, weeks, rate (a week) and censored."""
    horizon = horizon_weeks(history, policy).scalar() if horizon is None else horizon
    sold = cleaned_sales(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty"))
    weeks = weeks_on_floor(F.col("ageing_days"), F.col("sell_through"), F.col("weekly_sell_through"), horizon)
    return (
        history.withColumn("cleaned_sales", sold)
        .withColumn("weeks", weeks)
        .withColumn("rate", F.col("cleaned_sales") / F.col("weeks"))
        .withColumn("censored", is_censored(F.col("sell_through"), policy))
    )


def rate_priors(rated: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """Mean and spread of the log rate by category, item type and over all, from uncensored rows.

    level, item_type, category_type, mu, sigma (floored), rows; one rollup does all levels.
    """
    used = rated.where(~F.col("censored") & (F.col("rate") > 0)).select(_named("item_type").alias("item_type"), _named("category_type").alias("category_type"), F.log("rate").alias("y"))
    rolled = used.rollup("item_type", "category_type").agg(F.grouping_id().alias("g"), F.avg("y").alias("mu"), F.stddev_samp("y").alias("s"), F.count("*").alias("rows"))
    level = F.when(F.col("g") == 0, "category").when(F.col("g") == 1, "itemType").otherwise("global")
    floor = F.lit(policy.minimum_log_sigma)
    return rolled.where("rows > 0").select(level.alias("level"), "item_type", "category_type", "mu", F.greatest(F.coalesce("s", floor), floor).alias("sigma"), "rows")


def shrunk_priors(raw: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """Each item type drawn to the whole, and each category to its drawn item type, by its rows."""
    w = F.col("rows") / (F.col("rows") + policy.group_shrinkage_rows)
    drawn = lambda own, parent: w * F.col(own) + (1 - w) * parent
    whole = raw.where("level = 'global'")
    mu0, s0 = whole.select("mu").scalar(), whole.select("sigma").scalar()
    sigma = lambda parent: F.sqrt(w * F.col("sigma") * F.col("sigma") + (1 - w) * parent * parent)
    types = raw.where("level = 'itemType'").select("level", "item_type", "category_type", drawn("mu", mu0).alias("mu"), sigma(s0).alias("sigma"), "rows")
    parents = types.select(F.col("item_type").alias("_type"), F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))
    leaves = raw.where("level = 'category'").join(parents, F.col("item_type") == F.col("_type"))
    leaves = leaves.select("level", "item_type", "category_type", drawn("mu", F.col("_mu")).alias("mu"), sigma(F.col("_sigma")).alias("sigma"), "rows")
    return whole.unionByName(types).unionByName(leaves)


def shrinkage_tau(raw: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """One row: how many analogues weigh as much as the prior."""
    leaves = raw.where((F.col("level") == "category") & (F.col("rows") >= policy.group_shrinkage_rows))
    got = leaves.agg(F.count("*").alias("n"), F.avg(F.col("sigma") * F.col("sigma")).alias("within"), F.var_samp("mu").alias("between"))
    ratio = clamp(F.col("within") / F.when(F.col("between") > 1e-9, F.col("between")), 0.5, 20.0)
    return got.select(F.when(F.col("n") < 2, F.lit(4.0)).otherwise(F.coalesce(ratio, F.lit(20.0))).alias("tau"))


def greatest_seen(history: DataFrame) -> DataFrame:
    """(item_type, seen): the larger of order and sales of each row; a null type is ''."""
    seen = F.greatest(F.coalesce(F.col("order_qty").cast("double"), F.lit(0.0)), F.coalesce(F.col("sales_qty").cast("double"), F.lit(0.0)), F.lit(0.0))
    return history.select(F.coalesce("item_type", F.lit("")).alias("item_type"), seen.alias("seen"))


def buy_ceilings(history: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """(item_type, ceiling), and a row of null item type for all; blank types are one type ''."""
    rolled = greatest_seen(history).rollup("item_type").agg(F.grouping_id().alias("g"), F.max("seen").alias("seen"))
    return rolled.select(F.when(F.col("g") == 0, F.col("item_type")).alias("item_type"), F.greatest(F.coalesce("seen", F.lit(0.0)) * policy.ceiling_multiplier, F.lit(policy.ceiling_floor)).alias("ceiling"))


def with_ceiling(products: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Adds ``ceiling``: the item type's, or that of all."""
    own = ceilings.where("item_type is not null").select(F.col("item_type").alias("_type"), F.col("ceiling").alias("_own"))
    whole = ceilings.where("item_type is null").select("ceiling").scalar()
    joined = products.join(own, F.coalesce("item_type", F.lit("")) == F.col("_type"), "left")
    return joined.withColumn("ceiling", F.coalesce("_own", whole)).drop("_type", "_own")


def with_prior(products: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds prior_level, prior_mu and prior_sigma: of the category, else the item type, else of all."""
    at = lambda level, tag: priors.where(F.col("level") == level).select(F.col("item_type").alias(f"_t{tag}"), F.col("category_type").alias(f"_c{tag}"), F.struct(F.col("level").alias("level"), "mu", "sigma").alias(f"_p{tag}"))
    whole = priors.where("level = 'global'").select(F.struct(F.col("level").alias("level"), "mu", "sigma")).scalar()
    joined = products.join(at("category", 2), (_named("item_type") == F.col("_t2")) & (_named("category_type") == F.col("_c2")), "left")
    joined = joined.join(at("itemType", 1).drop("_c1"), _named("item_type") == F.col("_t1"), "left")
    joined = joined.withColumn("_p", F.coalesce("_p2", "_p1", whole))
    return joined.withColumns({"prior_level": F.col("_p.level"), "prior_mu": F.col("_p.mu"), "prior_sigma": F.col("_p.sigma")}).drop("_t1", "_t2", "_c2", "_p1", "_p2", "_p")


def corrected_rates(rated: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds corrected_rate, demand_censored and weekly_log_rate (six places).

    A product that sold out tells only that demand was at least what it sold, so its
    rate is the prior's mean above that.
    """
    lifted = F.col("censored") & (F.col("rate") > 0)
    out = with_prior(rated, priors)
    out = out.withColumn("demand_censored", lifted).withColumn("corrected_rate", F.when(lifted, lognormal_conditional_mean(F.col("prior_mu"), F.col("prior_sigma"), F.col("rate"))).otherwise(F.col("rate")))
    return out.withColumn("weekly_log_rate", F.when(F.col("corrected_rate") > 0, F.round(F.log("corrected_rate"), 6))).drop("prior_level", "prior_mu", "prior_sigma")


def pooled_demand(upcoming: DataFrame, accepted: DataFrame, history: DataFrame, priors: DataFrame, tau: Column, horizon: Column, policy: DemandPolicy = DEMAND) -> DataFrame:
    """A forecast for each upcoming product that has usable analogues.

    upcoming: id, item_type, category_type; accepted: left_id, right_id, visual_score,
    match_rank (1 for the best); history: id, corrected_rate, demand_censored.  The
    best four are taken before unusable ones are left out.
    """
    best = Window.partitionBy("left_id").orderBy("match_rank")
    top = accepted.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= policy.maximum_analogues)
    rates = history.where("corrected_rate > 0").select(F.col("id").alias("right_id"), F.log("corrected_rate").alias("y"), "demand_censored")
    used = top.where("visual_score is not null").join(rates, "right_id").withColumn("w", F.pow(F.greatest("visual_score", F.lit(1e-6)), F.lit(policy.similarity_exponent)))
    all_ = Window.partitionBy("left_id")
    used = used.withColumn("mean", F.sum(F.col("w") * F.col("y")).over(all_) / F.sum("w").over(all_))
    pooled = used.groupBy("left_id").agg(
        F.first("mean").alias("mean"),
        (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("effective_n"),
        (F.sum(F.col("w") * (F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean"))) / F.sum("w")).alias("spread"),
        F.count("*").alias("analogues_used"),
        F.count_if("demand_censored").alias("censored_analogues"),
    )
    out = with_prior(upcoming.join(pooled, F.col("id") == F.col("left_id")).drop("left_id"), priors)
    n, prior_variance = F.col("effective_n"), F.col("prior_sigma") * F.col("prior_sigma")
    share = n / (n + tau)
    variance = F.when(F.col("analogues_used") > 1, F.col("spread")).otherwise(prior_variance)
    core = (n * variance + tau * prior_variance) / (n + tau)
    out = out.withColumn("shrinkage_weight", share).withColumn("rate_mu", share * F.col("mean") + (1 - share) * F.col("prior_mu"))
    out = out.withColumn("log_sigma", clamp(F.sqrt(core * (1 + 1 / (n + tau))), policy.minimum_log_sigma, policy.maximum_log_sigma))
    out = out.withColumn("horizon_weeks", horizon).withColumn("log_mu", F.col("rate_mu") + F.log("horizon_weeks"))
    mu, s = F.col("log_mu"), F.col("log_sigma")
    return out.withColumns({
        "weekly_rate": F.exp("rate_mu"), "prior_weekly_rate": F.exp("prior_mu"), "median_demand": F.exp(mu), "mean_demand": F.exp(mu + s * s / 2),
        "point_demand": F.exp(mu + policy.point_skew * s * s / 2), "p10": F.exp(mu - P10_Z * s), "p90": F.exp(mu + P10_Z * s),
    }).drop("mean", "spread", "rate_mu", "prior_mu", "prior_sigma", "prior_level")


class Fitted(Mapping):
    """The tables of a fitted demand model, each made when it is first asked for.

    history (with corrected rates), rated, horizon, raw, priors, tau, ceilings.  What several
    others and the forecast read is written once; what nobody asks for is never made.
    """

    NAMES = ("rated", "raw", "priors", "tau", "horizon", "ceilings", "history")

    def __init__(self, history: DataFrame, policy: DemandPolicy) -> None:
        self.source, self.policy = settle(history, "history"), policy
        self.made: dict[str, DataFrame] = {}

    def _make(self, name: str) -> DataFrame:
        if name == "horizon":
            return settle(horizon_weeks(self.source, self.policy), "horizon")
        if name == "rated":
            return with_rates(self.source, self.policy, self["horizon"].scalar())
        if name == "raw":
            return settle(rate_priors(self["rated"], self.policy), "raw-priors")
        if name == "priors":
            return settle(shrunk_priors(self["raw"], self.policy), "priors")
        if name == "tau":
            return shrinkage_tau(self["raw"], self.policy)
        if name == "ceilings":
            return buy_ceilings(self.source, self.policy)
        return settle(corrected_rates(self["rated"], self["priors"]), "corrected")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)


def fit_demand(history: DataFrame, policy: DemandPolicy = DEMAND) -> Fitted:
    """The fitted tables of a history; each is made when it is asked for."""
    return Fitted(history, policy)


def published(fitted: Fitted) -> DataFrame:
    """What a build publishes of the model: (kind, key, value..) rows of priors and of buy ceilings, with horizon and tau."""
    one = {"horizon_weeks": F.round(fitted["horizon"].scalar(), 4), "tau": F.round(fitted["tau"].scalar(), 4)}
    six = lambda c: F.round(c, 6).alias(c)
    none = lambda c, t="double": F.lit(None).cast(t).alias(c)
    priors = fitted["priors"].select(F.lit("prior").alias("kind"), F.concat_ws("|", "item_type", "category_type").alias("key"), six("mu"), six("sigma"), "rows", none("ceiling"))
    ceilings = fitted["ceilings"].select(F.lit("ceiling").alias("kind"), F.coalesce("item_type", F.lit("")).alias("key"), none("mu"), none("sigma"), none("rows", "long"), F.round("ceiling", 2).alias("ceiling"))
    return priors.unionByName(ceilings).withColumns(one)
