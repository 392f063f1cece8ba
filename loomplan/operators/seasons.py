"""The demand model from statistics of seasons, so that a new season is added without reading old rows.

Of each group of products a season keeps the number, mean and sum of squared deviations of
the log rates of uncensored rows; of all rows, how many have how many weeks; of each item
type the largest order or sale.  These merge: counts add, deviations by the parallel
formula, maxima by the maximum.  Rows that don't tell their weeks lie on the floor for
the horizon, which a new season moves.  Their logarithms are kept apart, without the
weeks, and shifted by the horizon when the model is made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.functions.numeric import cleaned_sales, is_censored, tells_weeks, weeks_on_floor
from loomplan.operators.demand import UNNAMED, corrected_rates, greatest_seen, shrinkage_tau, shrunk_priors, told_weeks, upper_median
from loomplan.policy import DEMAND, DemandPolicy
from loomplan.sources.commits import commit, entries
from loomplan.sources.stage import settle

STATISTICS = "kind string, item_type string, category_type string, week double, n long, mean double, m2 double, most double"
CENSORED = "id string, item_type string, category_type string, cleaned_sales double, weeks double"
KEYS = ["kind", "item_type", "category_type", "week"]


def _rows(df: DataFrame, kind: Column | str, **columns: Column) -> DataFrame:
    """``df`` in the columns of ``STATISTICS``; those not given are null."""
    schema = dict(c.split(" ") for c in STATISTICS.split(", "))
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | columns
    return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def prepared(history: DataFrame, policy: DemandPolicy) -> DataFrame:
    """Adds cleaned_sales, weeks (null where a row doesn't tell them) and censored."""
    args = (F.col("ageing_days"), F.col("sell_through"), F.col("weekly_sell_through"))
    weeks = F.when(tells_weeks(*args), weeks_on_floor(*args, policy.fallback_horizon_weeks))
    return history.withColumns({"cleaned_sales": cleaned_sales(F.col("order_qty"), F.col("dispatch_qty"), F.col("sales_qty")), "weeks": weeks, "censored": is_censored(F.col("sell_through"), policy)})


def season_statistics(history: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """The statistics of one season's rows, a few for each group of products and for each number of weeks."""
    rows = prepared(history, policy)
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(UNNAMED)).otherwise(F.col(c)).alias(c)
    used = rows.where(~F.col("censored") & (F.col("cleaned_sales") > 0))
    y = F.log("cleaned_sales") - F.when(F.col("weeks").isNotNull(), F.log("weeks")).otherwise(F.lit(0.0))
    kind = F.when(F.col("weeks").isNotNull(), F.lit("told")).otherwise(F.lit("fallback")).alias("kind")
    by = used.select(kind, named("item_type"), named("category_type"), y.alias("y")).groupBy("kind", "item_type", "category_type").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v"))
    moments = _rows(by, F.col("kind"), item_type=F.col("item_type"), category_type=F.col("category_type"), n=F.col("n"), mean=F.col("mean"), m2=F.col("v") * F.col("n"))
    weeks = _rows(told_weeks(history, policy).groupBy("w").agg(F.count("*").alias("n")), "week", week=F.col("w"), n=F.col("n"))
    most = _rows(greatest_seen(history).groupBy("item_type").agg(F.max("seen").alias("most")), "ceiling", item_type=F.col("item_type"), most=F.col("most"))
    return moments.unionByName(weeks).unionByName(most)


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, m2) of rows (n, mean, m2) that share keys; deviations are taken from the common mean."""
    means = rows.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = rows.alias("a").join(means.alias("b"), same or F.lit(True))
    off = F.col("a.mean") - F.col("_mean")
    return both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def merged(statistics: DataFrame) -> DataFrame:
    """One table of statistics from those of several seasons, put together."""
    moments = pooled(statistics.where("kind in ('told', 'fallback')"), ["kind", "item_type", "category_type"])
    moments = _rows(moments, F.col("kind"), **{c: F.col(c) for c in ("item_type", "category_type", "n", "mean", "m2")})
    weeks = statistics.where("kind = 'week'").groupBy("week").agg(F.sum("n").alias("n"))
    most = statistics.where("kind = 'ceiling'").groupBy("item_type").agg(F.max("most").alias("most"))
    return moments.unionByName(_rows(weeks, "week", week=F.col("week"), n=F.col("n"))).unionByName(_rows(most, "ceiling", item_type=F.col("item_type"), most=F.col("most")))


def horizon(statistics: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """One row: the upper median of the weeks that rows tell."""
    return upper_median(statistics.where("kind = 'week'").select(F.col("week").alias("w"), "n"), policy)


def raw_priors(statistics: DataFrame, weeks: Column, policy: DemandPolicy = DEMAND) -> DataFrame:
    """``demand.rate_priors`` of all rows that the merged statistics stand for, at a horizon of ``weeks``."""
    away = F.when(F.col("kind") == "fallback", F.log(F.greatest(weeks, F.lit(1.0)))).otherwise(F.lit(0.0))
    rows = statistics.where("kind in ('told', 'fallback')").select("item_type", "category_type", "n", (F.col("mean") - away).alias("mean"), "m2")
    leaves = settle(pooled(rows, ["item_type", "category_type"]), "group-moments")
    types = settle(pooled(leaves, ["item_type"]), "type-moments")
    floor = F.lit(policy.minimum_log_sigma)
    sigma = F.greatest(F.coalesce(F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)), floor), floor).alias("sigma")
    none = lambda c: F.lit(None).cast("string").alias(c)
    level = lambda df, name, item_type, category: df.select(F.lit(name).alias("level"), item_type, category, F.col("mean").alias("mu"), sigma, F.col("n").alias("rows"))
    out = level(leaves, "category", F.col("item_type"), F.col("category_type"))
    out = out.unionByName(level(types, "itemType", F.col("item_type"), none("category_type")))
    return out.unionByName(level(pooled(types, []), "global", none("item_type"), none("category_type")))


def ceilings(statistics: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """``demand.buy_ceilings`` of all rows."""
    rolled = statistics.where("kind = 'ceiling'").rollup("item_type").agg(F.grouping_id().alias("g"), F.max("most").alias("most"))
    return rolled.select(F.when(F.col("g") == 0, F.col("item_type")).alias("item_type"), F.greatest(F.coalesce("most", F.lit(0.0)) * policy.ceiling_multiplier, F.lit(policy.ceiling_floor)).alias("ceiling"))


def censored_rows(history: DataFrame, policy: DemandPolicy = DEMAND) -> DataFrame:
    """What a season keeps of rows that sold out: their rates are corrected anew whenever the priors move."""
    rows = prepared(history, policy).where(F.col("censored") & (F.col("cleaned_sales") > 0))
    return rows.select(F.col("id").cast("string").alias("id"), "item_type", "category_type", "cleaned_sales", "weeks")


def recorrected(censored: DataFrame, priors: DataFrame, weeks: Column) -> DataFrame:
    """(id, corrected_rate, weekly_log_rate) of ``censored_rows`` under the priors and horizon of now."""
    rated = censored.withColumns({"rate": F.col("cleaned_sales") / F.coalesce("weeks", F.greatest(weeks, F.lit(1.0))), "censored": F.lit(True)})
    return corrected_rates(rated, priors).select("id", "corrected_rate", "weekly_log_rate")


class Seasons:
    """Seasons under ``root``, each committed once with its statistics and its rows that sold out."""

    def __init__(self, spark: SparkSession, root: str, policy: DemandPolicy = DEMAND) -> None:
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy

    def add(self, season: str, history: DataFrame) -> None:
        """Write a season and commit it; a season that is there already is refused, also when another writer adds it meanwhile."""

        def entry(before: list[tuple[int, dict]]) -> dict:
            if any(e["season"] == season for _, e in before):
                raise ValueError(f"season {season} is there already")
            return {"season": season, "part": part}

        part = f"season={uuid.uuid4().hex}"
        entry(entries(self.spark, self.root))
        rows = settle(history, "season")
        season_statistics(rows, self.policy).write.parquet(f"{self.root}/{part}/statistics")
        censored_rows(rows, self.policy).write.parquet(f"{self.root}/{part}/censored")
        commit(self.spark, self.root, entry)

    def _all(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{e['part']}/{table}" for _, e in entries(self.spark, self.root)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def fitted(self) -> dict[str, DataFrame]:
        """raw, priors, tau, horizon and ceilings of all seasons, and ``corrected``, the rates of rows that sold out."""
        statistics = settle(merged(self._all("statistics", STATISTICS)), "statistics")
        weeks = settle(horizon(statistics, self.policy), "horizon")
        raw = settle(raw_priors(statistics, weeks.scalar(), self.policy), "raw-priors")
        priors = settle(shrunk_priors(raw, self.policy), "priors")
        corrected = recorrected(self._all("censored", CENSORED), priors, weeks.scalar())
        return {"raw": raw, "priors": priors, "tau": shrinkage_tau(raw, self.policy), "horizon": weeks, "ceilings": ceilings(statistics, self.policy), "corrected": corrected}
