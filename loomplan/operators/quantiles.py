"""Exact percentiles by group without one task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.sources.stage import settle

#: Buckets that a group's distinct values are dealt to, by approximate quantiles.
BUCKETS = 256


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], *, weight: str | None = None, upper: bool = False) -> DataFrame:
    """(keys, n, q): the number of values of each group and their percentiles at ``shares``, linearly interpolated.

    ``weight``: a column that says how many times a row counts.  ``upper``: instead of between
    two values, the one of rank floor(share * n) from 0, at 0.5 the upper median.

    Values are counted, and distinct ones dealt to ranges; a window over the ranges' counts
    finds those that hold a wanted rank, and only these are put in order.  Nulls don't
    count; groups without values have no row.
    """
    counts = settle(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("n")), "value-counts")
    cuts = F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(4 * BUCKETS)))
    bounds = counts.groupBy(*keys).agg(cuts.alias("cuts"), F.sum("n").alias("total"))
    # A row for each group, of at most BUCKETS numbers.
    dealt = counts.join(bounds.select(*keys, "cuts"), keys).select(*keys, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))
    sums = dealt.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy(*keys).orderBy("bucket"))
    sums = sums.select(*keys, "bucket", (upto - F.col("in_bucket")).alias("before"), upto.alias("upto"))
    last = F.col("total") - 1
    place = lambda q: F.least(F.floor(F.lit(q) * F.col("total")), last) if upper else F.lit(q) * last
    asked = bounds.select(*keys, "total", F.explode(F.array_distinct(F.array(*[f(place(q)).cast("long") for q in shares for f in (F.floor, F.ceil)]))).alias("rank"))
    held = asked.join(sums, keys).where("before <= rank and rank < upto").select(*keys, "rank", "bucket", "before")
    wanted = held.select(*keys, "bucket", "before").distinct()
    ordered = Window.partitionBy(*keys, "bucket").orderBy("v")
    inside = dealt.join(wanted, [*keys, "bucket"]).select(*keys, "bucket", "v", "n", (F.col("before") + F.sum("n").over(ordered)).alias("end"))
    found = held.drop("before").join(inside, [*keys, "bucket"]).where("end - n <= rank and rank < end")
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))
    both = bounds.select(*keys, "total").join(values, keys)

    def at(q: float) -> Column:
        low, high = (F.element_at("values", f(place(q)).cast("long")) for f in (F.floor, F.ceil))
        return low + (place(q) - F.floor(place(q))) * (high - low)

    return both.select(*keys, F.col("total").alias("n"), F.array(*[at(q) for q in shares]).alias("q"))
