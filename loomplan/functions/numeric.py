"""Columns for the numeric rules: packs, rates, lognormal demand, scores, vectors and colours."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomplan.policy import DEMAND, MATCH, DemandPolicy, MatchPolicy

P10_Z = 1.2815515655446004

#: Step and terms of the trapezoidal sum for erfc: what is left out is under 1e-15 of the result.
STEP, TERMS = 0.5, 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(as_column(high), value))


def round_pack(value: Column, pack: int = DEMAND.pack) -> Column:
    """To a multiple of the pack; half a pack goes to the even multiple."""
    return (F.rint(value / pack) * pack).cast("long")


def cleaned_sales(order: Column, dispatch: Column, sales: Column) -> Column:
    """Sales, not under 0 and not over what was ordered or dispatched, whichever is more."""
    supply = F.greatest(_number(order), _number(dispatch), F.lit(0.0))
    sold = F.greatest(_number(sales), F.lit(0.0))
    return F.when(supply > 0, F.least(sold, supply)).otherwise(sold)


def tells_weeks(ageing_days: Column, sell_through: Column, weekly: Column) -> Column:
    """Whether a row says how long it was on sale; ``weeks_on_floor`` takes its fallback for others."""
    return (_number(ageing_days) > 0) | ((_number(sell_through) > 0) & (_number(weekly) > 0))


def weeks_on_floor(ageing_days: Column, sell_through: Column, weekly: Column, fallback: Column | float) -> Column:
    """Weeks that a product was on sale, at least one."""
    back = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    by_rate = F.when((_number(sell_through) > 0) & (_number(weekly) > 0), _number(sell_through) / _number(weekly))
    weeks = F.when(_number(ageing_days) > 0, _number(ageing_days) / 7.0).otherwise(F.coalesce(by_rate, back))
    return F.greatest(weeks, F.lit(1.0))


def is_censored(sell_through: Column, policy: DemandPolicy = DEMAND) -> Column:
    return _number(sell_through) >= policy.censor_sell_through


def quality_flags(order: Column, dispatch: Column, sales: Column, sell_through: Column) -> Column:
    """Names of what looks wrong in a product's figures."""
    o, d, s, t = map(_number, (order, dispatch, sales, sell_through))
    return F.array_compact(F.array(
        F.when((o > 0) & (d > o * 1.05), F.lit("dispatch_above_order")),
        F.when((d > 0) & (s > d * 1.02), F.lit("sales_above_dispatch")),
        F.when(t > 1, F.lit("sell_through_above_100")),
        F.when(F.least(o, d, s, t) < 0, F.lit("negative_value"))))


def erfc(x: Column) -> Column:
    """The complementary error function, by the trapezoidal rule with the term of its pole (Hunter and Regan).

    erfc(x) = h x exp(-x^2) / pi * (1 / x^2 + 2 sum of exp(-(n h)^2) / ((n h)^2 + x^2)) - 2 / (exp(2 pi x / h) - 1)
    """

    def positive(z: Column) -> Column:
        terms = [2 * math.exp(-((n * STEP) ** 2)) / (F.lit((n * STEP) ** 2) + z * z) for n in range(1, TERMS + 1)]
        sum_ = reduce(Column.__add__, terms, 1 / (z * z))
        pole = F.when(z < 6, 2 / F.expm1(z * (2 * math.pi / STEP))).otherwise(F.lit(0.0))
        return F.when(z < 1e-5, 1 - z * (2 / math.sqrt(math.pi))).otherwise(z * F.exp(-z * z) * (STEP / math.pi) * sum_ - pole)

    value = let(F.abs(x), positive)
    return F.when(x >= 0, value).otherwise(2 - value)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / 2**0.5)


def normal_tail(z: Column) -> Column:
    return 0.5 * erfc(z / 2**0.5)


def lognormal_conditional_mean(mu: Column, sigma: Column, floor: Column) -> Column:
    """The mean of a lognormal rate, given that it exceeds ``floor``."""
    mean = F.exp(mu + sigma * sigma / 2)
    z = (F.log(F.when(floor > 0, floor)) - mu) / F.when(sigma > 1e-9, sigma)
    tail, upper = normal_tail(z), normal_tail(z - sigma)
    return (
        F.when(floor <= 0, mean)
        .when(sigma <= 1e-9, F.greatest(F.exp(mu), floor))
        .when((tail <= 1e-9) | (upper <= 0), floor)
        .otherwise(F.greatest(mean * upper / tail, floor))
    )


def expected_sales(quantity: Column, mu: Column, sigma: Column) -> Column:
    """Mean of the lesser of lognormal demand and the quantity."""
    z = (F.log(F.when(quantity > 0, quantity)) - mu) / F.when(sigma > 1e-9, sigma)
    return (
        F.when(quantity <= 0, F.lit(0.0))
        .when(sigma <= 1e-9, F.least(F.exp(mu), quantity))
        .otherwise(F.exp(mu + sigma * sigma / 2) * normal_cdf(z - sigma) + quantity * normal_tail(z))
    )


def _tail(z: np.ndarray) -> np.ndarray:
    """The upper normal tail over an array, by the sum of ``erfc``."""
    x = np.maximum(np.abs(z) / 2**0.5, 1e-5)
    square = (np.arange(1, TERMS + 1) * STEP) ** 2
    sum_ = 1 / (x * x) + 2 * (np.exp(-square) / (square + (x * x)[:, None])).sum(axis=1)
    value = 0.5 * (x * np.exp(-x * x) * (STEP / np.pi) * sum_ - np.where(x < 6, 2 / np.expm1(np.minimum(x, 6) * (2 * np.pi / STEP)), 0))
    value = np.where(np.abs(z) < 1e-5, 0.5 - np.abs(z) / np.sqrt(2 * np.pi), value)
    return np.where(z >= 0, value, 1 - value)


@F.pandas_udf(DoubleType())
def newsvendor_z(sigma: pd.Series, target: pd.Series) -> pd.Series:
    """z = (ln quantity - mu) / sigma at which the expected sell-through is the target.

    The expected sell-through at z depends on sigma and the target alone, so one
    bisection serves a forecast and both ends of its band; it runs over a whole
    batch at once.  Null where either is null.
    """
    s, goal = sigma.to_numpy(dtype=np.float64, na_value=np.nan), np.clip(target.to_numpy(dtype=np.float64, na_value=np.nan), 0.01, 0.99)
    low, high = np.full(len(s), -40.0), np.full(len(s), 40.0)
    for _ in range(60):
        z = (low + high) / 2
        above = np.exp(-s * z + s * s / 2) * (1 - _tail(z - s)) + _tail(z) > goal
        low, high = np.where(above, z, low), np.where(above, high, z)
    out = pd.Series((low + high) / 2)
    return out.where(~(np.isnan(s) | np.isnan(goal)), None)


def newsvendor_order(mu: Column, sigma: Column, target: Column) -> Column:
    """The quantity whose expected sell-through is the target (held to 0.01 to 0.99)."""
    return F.when(sigma <= 1e-9, F.exp(mu) / clamp(target, 0.01, 0.99)).otherwise(F.exp(mu + sigma * newsvendor_z(sigma, target)))


def similarity(distance: Column, median: Column, scale: Column) -> Column:
    """Calibrated similarity of a distance: logistic, four places; null stays null."""
    x = clamp((distance - median) / F.greatest(scale, F.lit(1e-6)), -30.0, 30.0)
    return F.when(distance.isNotNull(), F.round(1 / (1 + F.exp(x)), 4))


def two_stage_score(first: Column, detail: Column, weight: Column | float) -> Column:
    """Both stages blended; the first alone where there is no detail; null without the first."""
    return F.when(first.isNotNull(), F.when(detail.isNull(), first).otherwise(F.round(first * (1 - weight) + detail * weight, 4)))


def hybrid_score(first: Column, detail: Column, colour: Column, texture: Column, policy: MatchPolicy = MATCH) -> Column:
    """Weighted mean of the signals that are there."""
    parts = [(two_stage_score(first, detail, policy.detail_weight), policy.neural_weight), (colour, policy.colour_weight), (texture, policy.texture_weight)]
    parts = [(s, w) for s, w in parts if w > 0]
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts), F.lit(0.0))
    mean = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0)) / F.when(total > 0, total)
    return F.round(mean, 4)


def shown_percent(score: Column | float) -> Column:
    """A score as the whole percent that is shown."""
    score = score if isinstance(score, Column) else F.lit(float(score))
    return F.floor(score * 100 + 0.5)


def match_confidence(score: Column, has_visual: Column, issues: Column, minimum: float = MATCH.minimum_score, high: float = MATCH.high_score) -> Column:
    top = F.coalesce(score, F.lit(0.0))
    return F.when((top >= high) & has_visual & (issues == 0), F.lit("High")).when((shown_percent(top) >= shown_percent(minimum)) & has_visual, F.lit("Medium")).otherwise(F.lit("Low"))


def no_suitable_match(score: Column, confidence: Column, minimum: float = MATCH.minimum_score) -> Column:
    """Whether the best candidate is no match: none, low, without a score, or shown below the minimum."""
    return F.coalesce((confidence == "Low") | (shown_percent(score) < shown_percent(minimum)), F.lit(True)) | score.isNull()


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_distance(a: Column, b: Column) -> Column:
    """1 - a.b, held to [0, 2], seven places: for vectors of length one."""
    return F.round(clamp(1 - inner_product(a, b), 0.0, 2.0), 7)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """Two zero vectors are at 0 from each other, one zero vector at 1 from any other."""
    x, y = norm(a), norm(b)
    none = lambda n: n <= 1e-12
    return F.when(none(x) & none(y), F.lit(0.0)).when(none(x) | none(y), F.lit(1.0)).otherwise(clamp(1 - inner_product(a, b) / (x * y), 0.0, 2.0))


def l2_normalize(a: Column, n: Column | None = None) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    unit = lambda v, n: F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(x.cast("double")))
    # Both bound once: named inside the transform they would be computed for each element.
    return let(a, lambda v: let(norm(v) if n is None else n, lambda m: unit(v, m)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """sRGB from 0 to 255 as CIE Lab under D65."""
    linear = [F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    # sRGB primaries and the D65 white.
    rows, white = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)), (0.95047, 1.0, 1.08883)
    xyz = [sum((c * w for c, w in zip(linear, row)), F.lit(0.0)) / top for row, top in zip(rows, white)]
    fx, fy, fz = (let(c, lambda v: F.when(v > 216 / 24389, F.cbrt(v)).otherwise((v * (24389 / 27) + 16) / 116)) for c in xyz)
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def _seventh(c: Column) -> Column:
    return let(F.pow(c, F.lit(7.0)), lambda p: F.sqrt(p / (p + F.lit(25.0**7))))


def _hue(y: Column, x: Column) -> Column:
    return let(F.degrees(F.atan2(y, x)), lambda h: F.when(h < 0, h + 360).otherwise(h))


def ciede2000(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """The CIEDE2000 difference of two Lab colours."""
    (l1, a1, b1), (l2, a2, b2) = left, right
    stretch = 1.5 - 0.5 * _seventh((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2)
    polar = let(stretch, lambda g: F.struct(F.hypot(a1 * g, b1).alias("c1"), F.hypot(a2 * g, b2).alias("c2"), _hue(b1, a1 * g).alias("h1"), _hue(b2, a2 * g).alias("h2")))

    def turn(p: Column) -> Column:
        d = p["h2"] - p["h1"]
        return F.when(p["c1"] * p["c2"] == 0, F.lit(0.0)).when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)

    def mean_hue(p: Column) -> Column:
        total = p["h1"] + p["h2"]
        near = F.abs(p["h1"] - p["h2"]) <= 180
        return F.when(p["c1"] * p["c2"] == 0, total).when(near, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)

    def terms(p: Column, hue: Column) -> Column:
        light, chroma = (l1 + l2) / 2, (p["c1"] + p["c2"]) / 2
        cos = lambda x: F.cos(F.radians(x))
        t = 1 - 0.17 * cos(hue - 30) + 0.24 * cos(2 * hue) + 0.32 * cos(3 * hue + 6) - 0.20 * cos(4 * hue - 63)
        off = (light - 50) * (light - 50)
        bend = 30 * F.exp(-F.pow((hue - 275) / 25, F.lit(2.0)))
        return F.struct(
            ((l2 - l1) / (1 + 0.015 * off / F.sqrt(20 + off))).alias("x"),
            ((p["c2"] - p["c1"]) / (1 + 0.045 * chroma)).alias("y"),
            (2 * F.sqrt(p["c1"] * p["c2"]) * F.sin(F.radians(turn(p) / 2)) / (1 + 0.015 * chroma * t)).alias("z"),
            (-2 * _seventh(chroma) * F.sin(F.radians(2 * bend))).alias("w"))

    def length(v: Column) -> Column:
        return F.sqrt(F.greatest(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] + v["w"] * v["y"] * v["z"], F.lit(0.0)))

    return let(polar, lambda p: let(mean_hue(p), lambda hue: let(terms(p, hue), length)))
