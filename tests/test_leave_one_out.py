"""Forecasts without a product against a model fitted anew from the others, in plain Python."""

import math
import random
import statistics

import pytest

from loomplan.operators import leave_one_out

HISTORY = "id string, item_type string, category_type string, order_qty long, dispatch_qty long, sales_qty long, sell_through double, ageing_days long, weekly_sell_through double"


def fit(rows):
    """(horizon, prior of a row, tau, corrected rate of a row) of a history."""
    named = lambda x: x or "UNSPECIFIED"

    def weeks(r, back):
        if (r["ageing_days"] or 0) > 0:
            w = r["ageing_days"] / 7
        elif (r["sell_through"] or 0) > 0 and (r["weekly"] or 0) > 0:
            w = r["sell_through"] / r["weekly"]
        else:
            w = back
        return max(w, 1.0)

    told = sorted(weeks(r, 38.0) for r in rows if (r["ageing_days"] or 0) > 0 or (r["weekly"] or 0) > 0)
    horizon = told[len(told) // 2] if told else 38.0
    rate = lambda r: r["cleaned"] / weeks(r, horizon)
    groups = {}
    for r in rows:
        if (r["sell_through"] or 0) < 0.95 and rate(r) > 0:
            for key in ((), (named(r["type"]),), (named(r["type"]), named(r["category"]))):
                groups.setdefault(key, []).append(math.log(rate(r)))
    raw = {k: (statistics.fmean(v), max(0.55, statistics.stdev(v) if len(v) > 1 else 0.55), len(v)) for k, v in groups.items()}
    shrunk = {}
    for key in sorted(raw, key=len):
        mu, sigma, n = raw[key]
        if key:
            pm, ps = shrunk[key[:-1]]
            w = n / (n + 8)
            mu, sigma = w * mu + (1 - w) * pm, math.sqrt(w * sigma**2 + (1 - w) * ps**2)
        shrunk[key] = (mu, sigma)
    big = [raw[k] for k in raw if len(k) == 2 and raw[k][2] >= 8]
    tau = 4.0
    if len(big) >= 2:
        between = statistics.variance([b[0] for b in big])
        tau = 20.0 if between <= 1e-9 else max(0.5, min(20.0, statistics.fmean(b[1] ** 2 for b in big) / between))
    prior = lambda r: next(shrunk[k] for k in ((named(r["type"]), named(r["category"])), (named(r["type"]),), ()) if k in shrunk)

    def corrected(r):
        x = rate(r)
        if (r["sell_through"] or 0) >= 0.95 and x > 0:
            mu, s = prior(r)
            z = (math.log(x) - mu) / s
            tail, upper = math.erfc(z / math.sqrt(2)) / 2, math.erfc((z - s) / math.sqrt(2)) / 2
            return x if tail <= 1e-9 or upper <= 0 else max(math.exp(mu + s * s / 2) * upper / tail, x)
        return x

    return horizon, prior, tau, corrected


def forecast(target, others, matches):
    horizon, prior, tau, corrected = fit(others)
    by_id = {r["id"]: r for r in others}
    used = [(max(s, 1e-6) ** 4, math.log(corrected(by_id[j]))) for j, s in matches[:4] if corrected(by_id[j]) > 0]
    if not used:
        return None
    w = sum(x for x, _ in used)
    mean = sum(x * y for x, y in used) / w
    n, spread = w * w / sum(x * x for x, _ in used), sum(x * (y - mean) ** 2 for x, y in used) / w
    pm, ps = prior(target)
    share, v = n / (n + tau), spread if len(used) > 1 else ps**2
    sigma = max(0.55, min(1.5, math.sqrt((n * v + tau * ps**2) / (n + tau) * (1 + 1 / (n + tau)))))
    return share * mean + (1 - share) * pm + math.log(horizon), sigma


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 41), (3, 12), (4, 2)])
def test_each_fold_equals_a_fit_of_the_others(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        order = rng.choice([0, rng.randrange(1, 3_000)])
        sold = rng.randrange(0, 2_500)
        days, weekly = rng.choice([(rng.randrange(20, 400), 0.0), (None, rng.uniform(0.001, 0.2)), (0, None)])
        rows.append({"id": f"H{i}", "type": rng.choice(["OTSH", "OTSH", "OTTR", "", "ONE"]), "category": rng.choice(["A", "A", "B", None]), "order": order, "sold": sold, "cleaned": float(min(sold, order) if order else sold), "sell_through": rng.choice([0.5, 0.7, 0.97, None]), "ageing_days": days, "weekly": weekly})
    history = spark.createDataFrame([(r["id"], r["type"], r["category"], r["order"], r["order"], r["sold"], r["sell_through"], r["ageing_days"], r["weekly"]) for r in rows], HISTORY)
    matches = {r["id"]: [(o["id"], rng.uniform(0.5, 1)) for o in rng.sample([o for o in rows if o is not r], min(5, n - 1))] for r in rows}
    accepted = spark.createDataFrame([(i, j, s, k + 1) for i, found in matches.items() for k, (j, s) in enumerate(found)], "left_id string, right_id string, visual_score double, match_rank int")
    got = {r["id"]: (r["log_mu"], r["log_sigma"]) for r in leave_one_out.refitted_forecasts(history, accepted).collect()}
    for r in rows:
        others = [o for o in rows if o is not r]
        try:
            expected = forecast(r, others, matches[r["id"]])
        except StopIteration:
            # No other row has a rate, so there is no prior.
            expected = None
        if expected is None:
            assert r["id"] not in got or got[r["id"]][0] is None
        else:
            assert got[r["id"]] == pytest.approx(expected, abs=1e-8), r
    if n > 30:
        assert len({round(forecast(r, [o for o in rows if o is not r], matches[r["id"]])[0], 9) for r in rows}) > 20
