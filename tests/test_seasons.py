"""The model from merged statistics against a fit of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomplan.operators import demand, seasons

HISTORY = "id string, item_type string, category_type string, order_qty long, dispatch_qty long, sales_qty long, sell_through double, ageing_days long, weekly_sell_through double"


def season(rng, name, n, types):
    rows = []
    for i in range(n):
        order = rng.randrange(0, 3_000)
        sold = int(order * rng.uniform(0, 1.1))
        # Some tell their days, some a weekly rate, some nothing.
        days, weekly = rng.choice([(rng.randrange(20, 400), 0.0), (None, rng.uniform(0, 0.2)), (0, None)])
        rows.append((f"{name}-{i}", rng.choice(types), rng.choice(["A", "B", "C", "", None]), order, order, sold, rng.choice([sold / order if order else 0.0, 0.97, None]), days, weekly))
    return rows


def priors_of(df):
    return {(r["level"], r["item_type"], r["category_type"]): (r["mu"], r["sigma"], r["rows"]) for r in df.collect()}


def test_two_seasons_equal_a_fit_of_all_rows(spark, tmp_path):
    rng = random.Random(2)
    a, b = season(rng, "old", 150, ["OTSH", "OTTR", "", None]), season(rng, "new", 90, ["OTTR", "OTWC", "ONE"])
    store = seasons.Seasons(spark, str(tmp_path / "seasons"))
    store.add("AW24", spark.createDataFrame(a, HISTORY).withColumn("kind", F.lit("clash")))
    before = store.fitted()["horizon"].first()[0]
    store.add("AW25", spark.createDataFrame(b, HISTORY))
    got, fit = store.fitted(), demand.fit_demand(spark.createDataFrame(a + b, HISTORY))
    assert got["horizon"].first()[0] == fit["horizon"].first()[0] != before
    for name in ("raw", "priors"):
        x, y = priors_of(got[name]), priors_of(fit[name])
        assert set(x) == set(y) and all(x[k][2] == y[k][2] and x[k][:2] == pytest.approx(y[k][:2], abs=1e-9) for k in y)
    assert got["tau"].first()[0] == pytest.approx(fit["tau"].first()[0], abs=1e-9)
    assert {tuple(r) for r in got["ceilings"].collect()} == {tuple(r) for r in fit["ceilings"].collect()}
    old = {r["id"]: r["corrected_rate"] for r in fit["history"].where("demand_censored").collect()}
    new = {r["id"]: r["corrected_rate"] for r in got["corrected"].collect()}
    assert set(old) == set(new) and all(math.isclose(new[k], old[k], rel_tol=1e-9) for k in old) and any(k.startswith("old") for k in old)


def test_a_season_counts_once(spark, tmp_path):
    rng = random.Random(3)
    store = seasons.Seasons(spark, str(tmp_path / "seasons"))
    assert store.fitted()["horizon"].first()[0] == 38.0
    rows = spark.createDataFrame(season(rng, "x", 30, ["OTSH"]), HISTORY)
    store.add("AW24", rows)
    with pytest.raises(ValueError, match="already"):
        store.add("AW24", rows)
    assert priors_of(store.fitted()["raw"]).keys() == priors_of(demand.fit_demand(rows)["raw"]).keys()


def test_upper_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [1.5, 1.25, 1.75, 1.5, 1.5, 7.0]):
        counts = spark.createDataFrame([(v,) for v in values], "w double").groupBy("w").agg(F.count("*").alias("n"))
        assert demand.upper_median(counts).first()[0] == sorted(values)[len(values) // 2]
