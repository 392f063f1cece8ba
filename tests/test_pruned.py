"""Exact search in large cohorts against brute force, and what it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomplan.operators import similarity
from loomplan.operators.pruned import Cells, portions

SCHEMA = "id string, ordinal long, item_type string, design string, vector array<double>"


def items(spark, name, vectors, item_type="OTSH"):
    return spark.createDataFrame([(f"{name}{i}", i, item_type, "X", [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(q, h, k):
    d = np.clip(1 - q @ h.T, 0, 2)
    return {(f"Q{i}", r + 1, f"H{j}") for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(h)), np.round(d[i], 12)))[:k])}


def got(frame):
    return {(r["left_id"], r["retrieval_rank"], r["right_id"]) for r in frame.collect()}


def clustered(rng, n, groups=20, spread=0.02):
    centres = unit(rng.normal(size=(groups, 8)))
    return unit(centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 8)))


def test_cells_that_cannot_hold_a_neighbour_are_skipped(spark):
    rng = np.random.default_rng(1)
    h, q = clustered(rng, 900), None
    q = unit(h[:40] + 0.01 * rng.normal(size=(40, 8)))
    right, left = items(spark, "H", h), items(spark, "Q", q)
    assert got(similarity.cohort_topk(left, right, 5, block=64)) == nearest(q, h, 5)
    cohort = lambda df: df.withColumn("cohort", F.lit("all"))
    cells = Cells(cohort(right), 64)
    n = cells.known.count()
    first = cells.targets(cohort(left), 5)
    near = cells.search(first, 5)
    marks = near.where("retrieval_rank = 5").select(F.col("left_id").alias("id"), F.col("distance").alias("mark"))
    met = first.count() + cells.targets(cohort(left), 5, marks).count()
    assert n > 40 and met < 0.2 * n * len(q)
    sizes = [r[0] for r in cells.known.select("n").collect()]
    assert sum(sizes) == 900


@pytest.mark.parametrize("case", ["apart", "equal", "unequal lengths", "opposite", "zero"])
def test_exact_where_bounds_tell_little(spark, case):
    rng = np.random.default_rng(3)
    h, q = unit(rng.normal(size=(300, 60))), unit(rng.normal(size=(12, 60)))
    if case == "equal":
        h = np.repeat(h[:3], 100, axis=0)
    elif case == "unequal lengths":
        h = h * rng.uniform(0.1, 3, size=(300, 1))
        q = q * 0.3
    elif case == "opposite":
        h = np.concatenate((np.tile(q[0], (150, 1)), np.tile(-q[0], (150, 1))))
    elif case == "zero":
        h[::2] = 0
    assert got(similarity.cohort_topk(items(spark, "Q", q), items(spark, "H", h), 7, block=32)) == nearest(q, h, 7)


def test_large_and_small_cohorts_together(spark):
    rng = np.random.default_rng(4)
    h, q = clustered(rng, 200), clustered(rng, 30)
    few, asked = unit(rng.normal(size=(9, 8))), unit(rng.normal(size=(4, 8)))
    right = items(spark, "H", h).union(items(spark, "S", few, "OTTR"))
    left = items(spark, "Q", q).union(items(spark, "T", asked, "OTTR")).union(items(spark, "N", asked, "NONE")).union(items(spark, "B", asked, None))
    found = got(similarity.cohort_topk(left, right, 6, block=20))
    small = {(a.replace("Q", "T"), r, b.replace("H", "S")) for a, r, b in nearest(asked, few, 6)}
    assert found == nearest(q, h, 6) | small


def test_calibration_hands_on_few_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for h, q in ((unit(rng.normal(size=(70, 6))), unit(rng.normal(size=(50, 6)))), (np.tile([1.0, 0.0], (30, 1)), np.tile([0.0, 1.0], (4, 1)))):
        right, left = items(spark, "H", h), items(spark, "Q", q)
        d = np.round(np.clip(1 - q @ h.T, 0, 2), 7)
        low, median, high = np.percentile(d, [10, 50, 90])
        for most in (5_000, 60):
            monkeypatch.setattr(similarity, "MOST_COUNTS", most)
            assert similarity.all_pairs_calibration(left, right, block=16) == pytest.approx((d.size, median, max((high - low) / (2 * np.log(9)), 1e-4)), abs=1e-9)
    assert similarity.all_pairs_calibration(left.limit(0), right) == (0, 0.5, 0.1)


def test_a_query_hands_on_its_best_once_for_each_portion(spark):
    """And not for each cell that it meets."""
    rng = np.random.default_rng(8)
    h, q = unit(rng.normal(size=(300, 30))), unit(rng.normal(size=(5, 30)))
    cohort = lambda df: df.withColumn("cohort", F.lit("all"))
    cells = Cells(cohort(items(spark, "H", h)), 16)
    assert cells.known.count() > 20
    most = cells.best(cohort(items(spark, "Q", q)), 5).groupBy("left_id").count().agg(F.max("count")).first()[0]
    assert most <= 5 * -(-300 // (16 * 16))


def test_rows_of_large_tables_are_shuffled_a_few_times(spark):
    sizes = spark.createDataFrame([(100,), (20_000,), (480_000,)], "n long").select(portions(F.col("n"), similarity.BLOCK))
    assert [r[0] for r in sizes.collect()] == [1, 5, 8]


def test_a_wrong_guess_of_the_ranges_costs_only_another_count(spark, monkeypatch):
    rng = np.random.default_rng(9)
    h = unit(rng.normal(size=(60, 6)))
    rows, apart = items(spark, "H", h), ~np.eye(60, dtype=bool)
    d = np.round(np.clip(1 - h @ h.T, 0, 2), 7)[apart]
    low, median, high = np.percentile(d, [10, 50, 90])
    for guess in (1, 1_024):
        monkeypatch.setattr(similarity, "GUESS", guess)
        assert similarity.all_pairs_calibration(rows, rows, others=True) == pytest.approx((3540, median, (high - low) / (2 * np.log(9))), abs=1e-9)


def test_all_distances_rank_nothing(spark, sf):
    from loomplan.plans.queries import QUERIES

    assert "Window" not in QUERIES["all_pairs_distance"](spark, sf)._jdf.queryExecution().executedPlan().toString()
