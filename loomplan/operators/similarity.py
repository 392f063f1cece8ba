"""Candidate retrieval, visual gates, calibration and ranking of matches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from loomplan.functions.numeric import hybrid_score, similarity
from loomplan.functions.text import TROUSER_TYPE, canonical_design, needs_pattern_gate, needs_trouser_gate, retrieval_key
from loomplan.operators.pruned import best_of, best_rows, kind, matrix, merged, portions, pruned_topk
from loomplan.operators.quantiles import exact_percentiles
from loomplan.policy import MATCH, MatchPolicy
from loomplan.sources.stage import settle

#: Rows of one cohort in a block, of the searched side as of the queries.
BLOCK = 4_096
#: The same where all pairs of two blocks are handed on.
ALL_BLOCK = 1_024
DELTA_E_SCALE = 50.0
#: Different distances to 7 places from 0 to 2, and counts that a block hands on at most.
DISTANCES, MOST_COUNTS = 20_000_001, 5_000
#: Rows and columns of the distances that a task has in memory at a time.
TILE = 256, 1_024
#: Rows of each side from whose distances the first ranges are guessed, and the share that these reach to each side of a wanted rank.
GUESS, MARGIN = 1_024, 0.01


def cohort_key(policy: MatchPolicy = MATCH) -> Column:
    """The key that query and candidate must share; null (no match) where a part is blank."""
    blank = lambda c: F.when(c != "", c)
    parts = []
    if policy.same_item_type:
        parts.append(blank(retrieval_key(F.col("item_type"))))
    if policy.same_design:
        parts.append(blank(canonical_design(F.col("design"))))
    return F.concat(*[x for p in parts for x in (p, F.lit("\x1f"))]) if parts else F.lit("all")


def _side(df: DataFrame, key: Column, side: str, blocks: DataFrame) -> DataFrame:
    """Rows with their cohort and its numbers of blocks, and the row's own block."""
    own = df.withColumn("cohort", key).where("cohort is not null").join(blocks, "cohort")
    return own.withColumn(f"{side}_block", F.pmod(F.xxhash64("id"), F.col(f"{side}_blocks")).cast("int"))


def _blocks_of(df: DataFrame, key: Column, side: str, block: int | None) -> DataFrame:
    n = F.count("*")
    blocks = F.ceil(n / block).cast("int") if block else portions(n, BLOCK)
    return df.select(key.alias("cohort")).where("cohort is not null").groupBy("cohort").agg(blocks.alias(f"{side}_blocks"))


def _met(left: DataFrame, right: DataFrame, key: Column, block: int | None):
    """The rows of each cohort of ``left`` and ``right`` (id, ordinal, vector), each block of one with each block of the other.

    Without a ``block`` a side is cut into ``portions``, so that a row is shuffled few times.
    """
    blocks = _blocks_of(left, key, "left", block).join(_blocks_of(right, key, "right", block), "cohort")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1)).alias(f"{side}_block")
    x = _side(left, key, "left", blocks).select("cohort", "left_block", every("right"), F.col("id").alias("left_id"), F.col("vector").alias("left_vector"))
    y = _side(right, key, "right", blocks).select("cohort", every("left"), "right_block", F.col("id").alias("right_id"), F.col("ordinal").alias("right_ordinal"), F.col("vector").alias("right_vector"))
    group = ["cohort", "left_block", "right_block"]
    return x.groupBy(*group).cogroup(y.groupBy(*group))


def cohort_topk(left: DataFrame, right: DataFrame, k: int, *, policy: MatchPolicy = MATCH, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, retrieval_rank, distance): the k nearest of the same cohort.

    left, right: id, ordinal, item_type, design, vector (unit length).  Both sides of a
    cohort are cut into blocks, so one large cohort is many tasks of bounded size; each
    multiplies matrices and hands on its best k for each query, and a window merges
    them.  A cohort of more than a block (and 4 k) rows is kept in cells, and a query meets
    only those that can hold one of its k nearest (``pruned``).  Ties go to the lower
    ordinal.  Distance is 1 - the inner product in double precision, held to [0, 2].
    """

    key = cohort_key(policy)
    # As many rows of a table as there are cohorts of more than a block.
    large = settle(right.select(key.alias("cohort")).groupBy("cohort").count().where(F.col("count") > max(block, 4 * k)).select("cohort"), "large-cohorts")
    direct = lambda x, y: merged(_met(x, y, key, block).applyInArrow(best_of(k), f"left_id {kind(left)}, right_id {kind(right)}, right_ordinal long, distance double"), k)
    if large.isEmpty():
        return direct(left, right)
    own = lambda df: df.withColumn("cohort", key)
    of = lambda df, how: own(df).join(large, "cohort", how)
    small = direct(of(left, "left_anti").drop("cohort"), of(right, "left_anti").drop("cohort"))
    return small.unionByName(pruned_topk(of(left, "left_semi"), of(right, "left_semi"), k, block))


def all_distances(left: DataFrame, right: DataFrame, *, block: int = ALL_BLOCK) -> DataFrame:
    """(left_id, right_id, distance) of all rows of ``left`` with all of ``right`` (id, ordinal, vector).

    Nothing is ranked or shuffled after a block of each side has met, and a task holds
    block * block pairs at a time, however long the tables are.
    """
    met = _met(left, right, F.lit("all"), block).applyInArrow(best_of(2**31 - 1), f"left_id {kind(left)}, right_id {kind(right)}, right_ordinal long, distance double")
    return met.drop("right_ordinal")


def _delta_e(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """CIEDE2000 over arrays of Lab colours."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(left, -1, 0), np.moveaxis(right, -1, 0)
    seventh = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    g = 1.5 - 0.5 * seventh((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2)
    c1, c2 = np.hypot(a1 * g, b1), np.hypot(a2 * g, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1 * g)) % 360, np.degrees(np.arctan2(b2, a2 * g)) % 360
    grey, turn = c1 * c2 == 0, (h2 - h1 + 180) % 360 - 180
    turn = np.where(grey, 0, np.where(np.abs(h2 - h1) == 180, h2 - h1, turn))
    hue = np.where(grey, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, ((h1 + h2) / 2 + 180) % 360))
    light, chroma = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(hue - 30) + 0.24 * cos(2 * hue) + 0.32 * cos(3 * hue + 6) - 0.20 * cos(4 * hue - 63)
    x = (l2 - l1) / (1 + 0.015 * (light - 50) ** 2 / np.sqrt(20 + (light - 50) ** 2))
    y = (c2 - c1) / (1 + 0.045 * chroma)
    z = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * chroma * t)
    twist = -2 * seventh(chroma) * np.sin(np.radians(60 * np.exp(-(((hue - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(x * x + y * y + z * z + twist * y * z, 0))


def palette_distance(left: Column | str, right: Column | str, least_weight: float = MATCH.palette_least) -> Column:
    """Distance of two palettes of (L, a, b, weight) entries: the nearest colours, weighted both ways, and the dominant ones.

    Entries of a weight not over ``least_weight`` don't count; two empty palettes are at 0,
    an empty and another at 2; a missing palette gives null.
    """

    @F.pandas_udf(DoubleType())
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        there = left.notna().to_numpy() & right.notna().to_numpy()
        out = np.full(len(left), np.nan)
        if there.any():
            a, b = (np.stack(s[there].to_numpy()).astype(np.float64).reshape(-1, 4, 4) for s in (left, right))
            in_a, in_b = (p[:, :, 3] > least_weight for p in (a, b))
            wa, wb = np.where(in_a, a[:, :, 3], 0), np.where(in_b, b[:, :, 3], 0)
            e = _delta_e(np.repeat(a[:, :, None, :3], 4, 2), np.repeat(b[:, None, :, :3], 4, 1))
            near_a = np.where(in_b[:, None, :], e, np.inf).min(2)
            near_b = np.where(in_a[:, :, None], e, np.inf).min(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (np.nansum(np.where(in_a, near_a, 0) * wa, 1) / wa.sum(1) + np.nansum(np.where(in_b, near_b, 0) * wb, 1) / wb.sum(1)) / 2
            at = np.arange(len(a))
            main = _delta_e(a[at, in_a.argmax(1), :3], b[at, in_b.argmax(1), :3])
            d = np.clip((0.7 * mean + 0.3 * main) / DELTA_E_SCALE, 0, 2)
            none_a, none_b = wa.sum(1) == 0, wb.sum(1) == 0
            out[there] = np.where(none_a & none_b, 0.0, np.where(none_a | none_b, 2.0, d))
        return pd.Series(out).where(there, None)

    return distance(left, right)


def gated_pairs(pairs: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """Adds colour_ok, pattern_gated and accepted to retrieved pairs, the colour gate first.

    pairs: left_item_type, left_design, right_design, colour_distance (null where a
    palette is missing), pattern_distance.
    """
    colour = F.lit(True) if not policy.colour_gate else F.coalesce(F.col("colour_distance") <= policy.colour_limit, F.lit(False))
    trousers = retrieval_key(F.col("left_item_type")) == TROUSER_TYPE
    others = F.lit(True) if policy.visual_only else needs_pattern_gate(F.col("left_design")) & needs_pattern_gate(F.col("right_design"))
    gated = F.when(trousers, needs_trouser_gate(F.col("left_design"))).otherwise(others)
    over = F.lit(policy.pattern_gate) & F.col("pattern_gated") & (F.col("pattern_distance") > policy.pattern_limit)
    out = pairs.withColumn("colour_ok", colour).withColumn("pattern_gated", F.col("colour_ok") & gated)
    return out.withColumn("accepted", F.col("colour_ok") & ~F.coalesce(over, F.lit(False)))


def accepted_pairs(gated: DataFrame) -> DataFrame:
    """Accepted pairs, ranked anew in order of retrieval."""
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy("retrieval_rank"))
    return gated.where("accepted").withColumn("candidate_rank", rank)


def gate_audit(queries: DataFrame, gated: DataFrame) -> DataFrame:
    """Counters over all and by item type (blank: UNSPECIFIED); queries: id, item_type."""
    count = lambda c, name: F.count_if(c).alias(name)
    ok, pattern, took = F.col("colour_ok"), F.col("pattern_gated"), F.col("accepted")
    by_query = gated.groupBy("left_id").agg(
        F.count("*").alias("retrieved"), count(~ok, "colour_rejected"), count(pattern, "pattern_applied"),
        count(ok & ~pattern, "pattern_bypassed"), count(ok & ~took, "pattern_rejected"), count(took, "accepted"))
    names = [c for c in by_query.columns if c != "left_id"]
    item_type = F.when(F.coalesce("item_type", F.lit("")) == "", F.lit("UNSPECIFIED")).otherwise(F.col("item_type"))
    all_ = queries.select("id", item_type.alias("item_type")).join(by_query, F.col("id") == F.col("left_id"), "left").fillna(0, names)
    sums = [F.sum(c).alias(c) for c in names]
    rolled = all_.rollup("item_type").agg(F.grouping_id().alias("g"), F.count("*").alias("queries"), *sums, count(F.col("accepted") == 0, "without_accepted"))
    return rolled.select(F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col("item_type")).alias("item_type"), "queries", *names, "without_accepted")


def calibration(distances: DataFrame) -> DataFrame:
    """(scope, signal, n, median, scale, q10, q90) of long rows (scope, signal, distance).

    Exact percentiles with linear interpolation; the scale makes the logistic fall
    from 0.9 to 0.1 between q10 and q90.
    """
    got = exact_percentiles(distances, ["scope", "signal"], "distance", [0.1, 0.5, 0.9])
    q = lambda i: F.get("q", F.lit(i))
    return got.select("scope", "signal", "n", q(1).alias("median"), F.greatest((q(2) - q(0)) / (2 * math.log(9)), F.lit(1e-4)).alias("scale"), q(0).alias("q10"), q(2).alias("q90"))


def serving_calibration(fitted: DataFrame, signals: list[str]) -> DataFrame:
    """(signal, median, scale) for scoring: of the serving scope, else the history, else the default."""
    spark = fitted.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, signals))).alias("signal"))
    at = lambda scope: fitted.where(F.col("scope") == scope).select("signal", F.struct("median", "scale").alias(scope))
    joined = names.join(at("serving"), "signal", "left").join(at("historical"), "signal", "left")
    best = F.coalesce("serving", "historical", F.struct(F.lit(0.5).alias("median"), F.lit(0.1).alias("scale")))
    return joined.select("signal", best.alias("c")).select("signal", "c.median", "c.scale")


SIGNALS = ["fashion", "detail", "colour", "texture"]


def scored_pairs(pairs: DataFrame, served: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """Adds <signal>_score, visual_score and hybrid_score to pairs with <signal>_distance columns."""
    table = served.agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("median", "scale")))).alias("m")).scalar()
    out = pairs.withColumn("_c", table)
    for s in SIGNALS:
        c = F.try_element_at("_c", F.lit(s))
        out = out.withColumn(f"{s}_score", similarity(F.col(f"{s}_distance"), c["median"], c["scale"]))
    out = out.withColumn("visual_score", hybrid_score(*[F.col(f"{s}_score") for s in SIGNALS], policy))
    return out.withColumn("hybrid_score", F.round(F.coalesce("visual_score", F.lit(0.0)), 4)).drop("_c")


def ranked(scored: DataFrame) -> DataFrame:
    """match_rank: by hybrid score, then history order (right_ordinal)."""
    return scored.withColumn("match_rank", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("hybrid_score"), "right_ordinal")))


def _tiles(a: pa.Table, b: pa.Table, others: bool):
    """(first row of ``a``, first row of ``b``, inner products) by tiles, all of some rows of ``a`` in order; -inf for a row itself if only ``others`` count."""
    if len(a) and len(b):
        y = matrix(b["right_vector"])
        own = pc.index_in(a["left_id"], value_set=b["right_id"]).fill_null(-1).to_numpy() if others else None
        rows, columns = TILE
        for at in range(0, len(a), rows):
            x = matrix(a["left_vector"].slice(at, rows))
            for to in range(0, len(b), columns):
                g = x @ y[to : to + columns].T
                if others:
                    column = own[at : at + rows] - to
                    i = np.flatnonzero((column >= 0) & (column < g.shape[1]))
                    g[i, column[i]] = -np.inf
                yield at, to, g


def _units(g: np.ndarray) -> np.ndarray:
    """Distances of inner products in units of 1e-7."""
    return np.rint(np.clip(1 - g, 0, 2) * 1e7).astype(np.int64)


def all_pairs_calibration(left: DataFrame, right: DataFrame, *, block: int | None = None, others: bool = False) -> tuple[int, float, float]:
    """(n, median, scale) of the distances, to 7 places, of all rows of ``left`` to all of ``right``.

    Exact, by the rule of ``calibration``; with ``others`` a row's distance to itself (the
    same id) doesn't count.  The distances of ``GUESS`` rows of each side tell about where
    the wanted ranks lie.  All distances are then counted: how many are under some windows,
    and how many in each range of these, of which a block hands on at most ``MOST_COUNTS``.
    The range, or the gap between windows, that holds a wanted rank is the next window,
    until a range is a single distance; so a wrong guess costs one more count and no more.
    """

    def counted(windows: list[tuple[int, int, int]]) -> tuple[int, list[int], list[np.ndarray]]:
        """The number of distances, and for each window (start, end, width of a range) those under it and in each range."""
        sizes = [-(-(end - start) // width) for start, end, width in windows]
        first = np.cumsum([1 + len(windows), *sizes])
        # A distance's place is decided by rounding; these bounds are wider by a unit.
        top = [np.inf if start == 0 else 1 - (start - 1) * 1e-7 for start, _, _ in windows]
        low = [-np.finfo(np.float64).max if end >= DISTANCES else 1 - (end + 1) * 1e-7 for _, end, _ in windows]

        def count(a: pa.Table, b: pa.Table) -> pa.Table:
            out = np.zeros(first[-1], dtype=np.int64)
            for _, _, g in _tiles(a, b, others):
                g = g.ravel()
                out[0] += np.count_nonzero(g > -np.inf) if others else len(g)
                for w, (start, end, width) in enumerate(windows):
                    near = g > top[w]
                    out[1 + w] += np.count_nonzero(near)
                    d = _units(g[np.flatnonzero(near ^ (g >= low[w]))])
                    out[1 + w] += np.count_nonzero(d < start)
                    d = d[(d >= start) & (d < end)]
                    out[first[w] : first[w + 1]] += np.bincount((d - start) // width, minlength=sizes[w])
            held = np.flatnonzero(out)
            return pa.table({"place": held, "n": out[held]})

        met = _met(left, right, F.lit("all"), block).applyInArrow(count, "place long, n long")
        out = np.zeros(first[-1], dtype=np.int64)
        for r in met.groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]
        return int(out[0]), [int(x) for x in out[1 : 1 + len(windows)]], [out[i:j] for i, j in zip(first, first[1:])]

    shares = (0.1, 0.5, 0.9)
    spans = sorted(_guessed(left, right, shares))
    under: dict[int, int] = {0: 0}
    ranks: list[int] = []
    value: dict[int, int] = {}
    while True:
        per = max(MOST_COUNTS // max(len(spans), 1), 2)
        windows = [(start, end, -(-(end - start) // per)) for start, end in spans]
        total, below, counts = counted(windows)
        if not total:
            return 0, 0.5, 0.1
        places = [q * (total - 1) for q in shares]
        ranks = ranks or sorted({f(p) for p in places for f in (math.floor, math.ceil)})
        # How many distances are under each bound known so far.
        for (start, end, width), n, inside in zip(windows, below, counts):
            upto = n + np.concatenate([[0], np.cumsum(inside)])
            under |= {min(start + i * width, end): int(c) for i, c in enumerate(upto)}
        bounds = np.array(sorted(under))
        counted_to = np.array([under[int(b)] for b in bounds])
        spans = set()
        for rank in ranks:
            i = int(np.searchsorted(counted_to, rank, side="right")) - 1
            start, end = int(bounds[i]), int(bounds[i + 1]) if i + 1 < len(bounds) else DISTANCES
            value[rank] = start
            if end - start > 1:
                spans.add((start, end))
        if not spans:
            break
        spans = sorted(spans)
    of = lambda rank: value[rank] / 1e7
    q10, median, q90 = (of(math.floor(p)) + (p - math.floor(p)) * (of(math.ceil(p)) - of(math.floor(p))) for p in places)
    return total, median, max((q90 - q10) / (2 * math.log(9)), 1e-4)


def _guessed(left: DataFrame, right: DataFrame, shares: tuple[float, ...]) -> list[tuple[int, int]]:
    """Windows of distances in units of 1e-7 that probably hold the percentiles at ``shares``, apart from each other."""
    some = lambda df: df.select("vector").orderBy(F.xxhash64("id")).limit(GUESS).toArrow()["vector"]
    x, y = some(left), some(right)
    if not len(x) or not len(y):
        return []
    d = _units(matrix(x) @ matrix(y).T).ravel()
    out: list[tuple[int, int]] = []
    for q in shares:
        start, end = (int(v) for v in np.quantile(d, [max(q - MARGIN, 0), min(q + MARGIN, 1)], method="nearest"))
        start = max(start, out[-1][1]) if out else start
        if end + 1 > start:
            out.append((start, end + 1))
    return out


def whole_one_stage(left: DataFrame, right: DataFrame, products: DataFrame, k: int, *, block: int | None = None, others: bool = False, calibrated: tuple[float, float] | None = None) -> DataFrame:
    """(left_id, right_id, right_ordinal, distance, visual_score, hybrid_score, match_rank): the best k of the whole history.

    Every row of ``left`` is scored against every row of ``right`` (id, ordinal, vector),
    whatever their item types, with the calibration of all those pairs, or the median and
    scale that ``calibrated`` gives.  A row of ``right``
    without a vector, and all of them for ``products`` (id) that aren't in ``left``, have a
    null score that ranks as 0, in order.  With ``others`` a row doesn't meet itself.  A
    block keeps its best k by rounded score, then order, so ties at the last place are right.
    """
    seen = right.where("vector is not null")
    median, scale = calibrated or all_pairs_calibration(left, seen, block=block, others=others)[1:]

    fall = max(scale, 1e-6)

    def scores(d: np.ndarray) -> np.ndarray:
        return np.rint(1e4 / (1 + np.exp(np.clip((d / 1e7 - median) / fall, -30, 30))))

    def reaching(score: np.ndarray) -> np.ndarray:
        """An inner product that every row of at least this score has; -inf for 0 and less, inf over 10,000."""
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.log(1e4 / (score - 0.5 - 1e-4) - 1)
        g = 1 - (median + fall * x) - 2e-7
        return np.where(score <= 0, -np.inf, np.where(score > 10_000, np.inf, g))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("right_ordinal")
        out, none = [], (np.array([], np.int64),) * 4

        def done(at: int, kept: tuple) -> None:
            row, column, d, _ = kept
            out.append(pa.table({"left_id": a["left_id"].take(pa.array(at + row)), "right_id": b["right_id"].take(pa.array(column)), "right_ordinal": b["right_ordinal"].take(pa.array(column)), "distance": d / 1e7}))

        now, kept, mark = None, none, None
        for at, to, g in _tiles(a, b, others):
            if at != now:
                if now is not None:
                    done(now, kept)
                now, kept = at, none
                # From the first tile all that score as its k-th best do, from others only what scores more: they come later in order.
                mark = np.full(len(g), -np.inf)
                if k < g.shape[1]:
                    last = np.partition(g, g.shape[1] - k, axis=1)[:, g.shape[1] - k]
                    mark = np.where(last > -np.inf, reaching(scores(_units(last))), -np.inf)
            row, column = np.nonzero(g >= mark[:, None])
            product = g[row, column]
            there = product > -np.inf
            if there.any():
                row, column, d = row[there], to + column[there], _units(product[there])
                row, column, d, score = (np.concatenate(x) for x in zip(kept, (row, column, d, scores(d))))
                keep = best_rows(k, row, -score, column)
                kept = row, column, d, score = row[keep], column[keep], d[keep], score[keep]
                last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                mark = np.full(len(g), -np.inf)
                mark[row[last]] = reaching(score[last] + 1)
        if now is not None:
            done(now, kept)
        return pa.concat_tables(out) if out else pa.table({"left_id": a["left_id"].slice(0, 0), "right_id": b["right_id"].slice(0, 0), "right_ordinal": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    near = _met(left, seen, F.lit("all"), block).applyInArrow(best, f"left_id {kind(left)}, right_id {kind(right)}, right_ordinal long, distance double")
    near = near.withColumn("visual_score", similarity(F.col("distance"), F.lit(median), F.lit(scale)))
    unscored = {"distance": F.lit(None).cast("double"), "visual_score": F.lit(None).cast("double")}
    # At most k + 1 rows each: what stands first in order, and that without a vector.
    first = lambda df: df.select(F.col("id").alias("right_id"), F.col("ordinal").alias("right_ordinal")).orderBy("right_ordinal").limit(k + others)
    blind = products.join(left.select("id"), "id", "left_anti").select(F.col("id").alias("left_id")).join(F.broadcast(first(right)), F.lit(True))
    behind = left.select(F.col("id").alias("left_id")).join(F.broadcast(first(right.where("vector is null"))), F.lit(True))
    blind = blind.unionByName(behind).withColumns(unscored)
    both = near.unionByName(blind.where("left_id <> right_id") if others else blind)
    return ranked(both.withColumn("hybrid_score", F.round(F.coalesce("visual_score", F.lit(0.0)), 4))).where(F.col("match_rank") <= k)


def match_lists(ranked_: DataFrame, k: int = MATCH.published) -> DataFrame:
    """(left_id, matches): the best k as an array of structs in order."""
    entry = F.struct("match_rank", F.col("right_id").alias("historical_id"), "visual_score", "hybrid_score")
    return ranked_.where(F.col("match_rank") <= k).groupBy("left_id").agg(F.array_sort(F.collect_list(entry)).alias("matches"))
