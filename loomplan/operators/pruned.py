"""Exact nearest neighbours in large cohorts, where cells that can't hold one are never joined.

A cohort's rows are dealt to the nearest of some pivots, and those of a pivot to rings by
their distance to it.  Such a cell is known by its pivot c, the least and largest distance
lo and hi of its rows to c, and their largest length m.  By the triangle inequality no row
of it is nearer to q than d = max(0, |q - c| - hi, lo - |q - c|), so no inner product with q
is over (m * m + |q| * |q| - d * d) / 2; for vectors of length one that is tight.

A query first meets its most promising cells, just as many as hold k rows; the k-th best
of these is the mark.  It then meets those other cells whose bound reaches the mark, and
no more.  Where the bounds tell nothing (vectors as far apart as can be), it meets all:
the result is exact always, only the work differs.

Queries meet the cells inside a task that holds a portion of both sides, so a vector is
shuffled once for each portion of the other side, and a query's k best are handed on once
for each portion of the rows, however many cells there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.sources.stage import settle

#: Pivots of a cohort at most, and rings of a pivot: a cohort's cells fit in one call, whatever its size.
PIVOTS, RINGS = 256, 16
#: Blocks in a portion at most, and portions of a side that fits in so many.
BLOCKS, PORTIONS = 16, 8
#: Bounds are computed with errors of about 1e-15; cells this near to the mark are looked at.
SLACK = 1e-9
CELL = ["cohort", "cluster", "ring"]


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as a matrix."""
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def portions(n: Column, block: int) -> Column:
    """How many portions n rows are cut into: for tasks enough, and none of more than ``BLOCKS`` blocks."""
    return F.ceil(n / F.greatest(F.lit(block), F.least(F.lit(BLOCKS * block), F.ceil(n / PORTIONS)))).cast("int")


def kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def best_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of the second table for each of the first: left_id, right_id, right_ordinal, distance."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            b = b.sort_by("right_ordinal")
            y = matrix(b["right_vector"])
            for at in range(0, len(a), 512):
                part = a.slice(at, 512)
                d = 1 - matrix(part["left_vector"]) @ y.T
                rows = np.arange(len(d))[:, None]
                if k < d.shape[1]:
                    # All that are as near as the k-th, so that ties at the last place go by order.
                    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    row, column = np.nonzero(d <= last)
                else:
                    row, column = (x.ravel() for x in np.broadcast_arrays(rows, np.arange(d.shape[1])[None, :]))
                out.append(pa.table({"left_id": part["left_id"].take(pa.array(row)), "right_id": b["right_id"].take(pa.array(column)), "right_ordinal": b["right_ordinal"].take(pa.array(column)), "distance": np.clip(d[row, column], 0, 2)}))
        return pa.concat_tables(out) if out else pa.table({"left_id": a["left_id"].slice(0, 0), "right_id": b["right_id"].slice(0, 0), "right_ordinal": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    return best


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``."""
    return np.sqrt(np.maximum(np.square(x).sum(1)[:, None] + np.square(y).sum(1)[None, :] - 2 * x @ y.T, 0))


def best_rows(k: int, row: np.ndarray, distance: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """Places of each row's k least distances, by row, distance and ordinal."""
    order = np.lexsort((ordinal, distance, row))
    held = row[order]
    return order[np.arange(len(order)) - np.searchsorted(held, held) < k]


def best_in_cells(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``best_of`` for rows with their cluster and ring, where a query meets only cells that can hold one of its k nearest."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            b = b.sort_by([("cluster", "ascending"), ("ring", "ascending"), ("right_ordinal", "ascending")])
            y, ordinal = matrix(b["right_vector"]), b["right_ordinal"].to_numpy()
            cell = b["cluster"].to_numpy().astype(np.int64) * RINGS + b["ring"].to_numpy()
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            n = np.diff(starts, append=len(y))
            centre = np.add.reduceat(y, starts) / n[:, None]
            away = np.linalg.norm(y - np.repeat(centre, n, axis=0), axis=1)
            lo, hi, longest = np.minimum.reduceat(away, starts), np.maximum.reduceat(away, starts), np.maximum.reduceat(np.linalg.norm(y, axis=1), starts)
            # Queries of one neighbourhood go together.
            a = a.take(pa.array(np.argsort(np.concatenate([_apart(matrix(a["left_vector"].slice(at, 512)), centre).argmin(axis=1) for at in range(0, len(a), 512)]), kind="stable")))
            for at in range(0, len(a), 512):
                x = matrix(a["left_vector"].slice(at, 512))
                apart = _apart(x, centre)
                gap = np.maximum(0, np.maximum(apart - hi, lo - apart))
                least = np.clip(1 - (np.square(longest) + np.square(x).sum(1)[:, None] - np.square(gap)) / 2, 0, 2)
                order = np.lexsort((apart, least), axis=1)
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(least.shape, dtype=bool)
                np.put_along_axis(first, order, before < k, axis=1)
                mark = np.full(len(x), np.inf)
                found = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]

                def settled() -> None:
                    row, column, d = (np.concatenate(c) for c in zip(*found))
                    keep = best_rows(k, row, d, ordinal[column])
                    row, column, d = row[keep], column[keep], d[keep]
                    found[:] = [(row, column, d)]
                    last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                    mark[row[last]] = d[last]

                for later in (False, True):
                    held = 0
                    for c in np.argsort(least.min(axis=0), kind="stable"):
                        asked = np.flatnonzero(~first[:, c] & (least[:, c] <= mark + SLACK) if later else first[:, c])
                        if len(asked):
                            d = np.clip(1 - x[asked] @ y[starts[c] : starts[c] + n[c]].T, 0, 2)
                            i, j = np.nonzero(d <= mark[asked][:, None])
                            found.append((asked[i], starts[c] + j, d[i, j]))
                            held += len(i)
                            if held > 4 * k * len(x):
                                settled()
                                held = 0
                    settled()
                row, column, d = found[0]
                out.append(pa.table({"left_id": a["left_id"].take(pa.array(at + row)), "right_id": b["right_id"].take(pa.array(column)), "right_ordinal": ordinal[column], "distance": d}))
        return pa.concat_tables(out) if out else pa.table({"left_id": a["left_id"].slice(0, 0), "right_id": b["right_id"].slice(0, 0), "right_ordinal": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    return best


def _parts(rows: DataFrame, block: int) -> DataFrame:
    """Rows with ``parts``, how many portions their cohort has, and their own ``part``."""
    n = rows.groupBy("cohort").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return rows.join(n, "cohort").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))


def _beside(rows: DataFrame, few: DataFrame):
    """Portions of ``rows``, each beside all that its cohort has in ``few``."""
    counts = rows.select("cohort", "parts").distinct()
    every = few.join(counts, "cohort").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.drop("parts").groupBy("cohort", "part").cogroup(every.groupBy("cohort", "part"))


class Cells:
    """The rows of large cohorts (cohort, id, ordinal, vector) in cells, and what is known of each cell."""

    def __init__(self, right: DataFrame, block: int) -> None:
        self.block = block
        right = settle(right.select("cohort", "id", "ordinal", "vector"), "large-cohorts")
        wanted = right.groupBy("cohort").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") * 4 / block)).alias("wanted"))
        place = F.row_number().over(Window.partitionBy("cohort").orderBy(F.xxhash64("id"), "ordinal"))
        drawn = right.select("cohort", "id", "ordinal", "vector").withColumn("place", place).where(F.col("place") <= PIVOTS).join(wanted, "cohort").where("place <= wanted")
        self.pivots = settle(drawn.select("cohort", (F.col("place") - 1).alias("cluster"), F.col("vector").alias("pivot")), "pivots")

        def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
            if not len(rows):
                return pa.table({c: pa.array([], t) for c, t in (("cohort", pa.string()), ("id", rows["id"].type), ("ordinal", pa.int64()), ("vector", pa.list_(pa.float64())), ("cluster", pa.int32()), ("away", pa.float64()), ("length", pa.float64()))})
            x, c = matrix(rows["vector"]), matrix(pivots["pivot"])
            d = _apart(x, c)
            own = d.argmin(axis=1)
            return pa.table({"cohort": rows["cohort"], "id": rows["id"], "ordinal": rows["ordinal"], "vector": rows["vector"], "cluster": pivots["cluster"].combine_chunks().take(pa.array(own)).cast(pa.int32()), "away": d[np.arange(len(d)), own], "length": np.linalg.norm(x, axis=1)})

        dealt = _beside(_parts(right, block), self.pivots).applyInArrow(assign, f"cohort string, id {kind(right)}, ordinal long, vector array<double>, cluster int, away double, length double")
        dealt = settle(dealt, "clustered")
        cuts = dealt.groupBy("cohort", "cluster").agg(F.percentile_approx("away", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), F.lit(1_000)).alias("cuts"), F.count("*").alias("n"))
        # A small cluster is one ring; others have a ring for each quarter of a block, at most RINGS.
        rings = F.least(F.lit(RINGS), F.ceil(F.col("n") * 4 / block))
        ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("away"))) * rings / RINGS).cast("int")
        self.rows = settle(dealt.join(cuts, ["cohort", "cluster"]).select("cohort", "cluster", ring.alias("ring"), "id", "ordinal", "vector", "away", "length"), "cells")

    @cached_property
    def known(self) -> DataFrame:
        known = self.rows.groupBy(*CELL).agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.max("length").alias("longest"), F.count("*").alias("n"))
        return settle(known.join(self.pivots, ["cohort", "cluster"]), "known-cells")

    def best(self, left: DataFrame, k: int) -> DataFrame:
        """The k best of each query (cohort, id, vector) in each portion of its cohort."""
        lefts = left.groupBy("cohort").agg(portions(F.count("*"), self.block).alias("lefts"))
        # Few portions of the rows: each hands on k for every query.
        sizes = self.rows.groupBy("cohort").agg(F.ceil(F.count("*") / (BLOCKS * self.block)).cast("int").alias("rights")).join(lefts, "cohort")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
        x = left.join(sizes, "cohort").withColumn("l", own("lefts")).select("cohort", "l", every("rights").alias("r"), F.col("id").alias("left_id"), F.col("vector").alias("left_vector"))
        y = self.rows.join(sizes, "cohort").withColumn("r", own("rights")).select("cohort", every("lefts").alias("l"), "r", "cluster", "ring", F.col("id").alias("right_id"), F.col("ordinal").alias("right_ordinal"), F.col("vector").alias("right_vector"))
        group = ["cohort", "l", "r"]
        return x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(best_in_cells(k), f"left_id {kind(left)}, right_id {kind(self.rows)}, right_ordinal long, distance double")

    def targets(self, left: DataFrame, k: int, marks: DataFrame | None = None) -> DataFrame:
        """(cohort, cluster, ring, id, vector): the cells that queries (cohort, id, vector) are to meet.

        Without ``marks`` each query's most promising ones that hold k rows; with them (id,
        mark: a query's k-th distance so far) the others that may hold a nearer row.
        """

        later = marks is not None

        def chosen(rows: pa.Table, cells: pa.Table) -> pa.Table:
            if not len(rows) or not len(cells):
                return pa.table({"cohort": pa.array([], pa.string()), "cluster": pa.array([], pa.int32()), "ring": pa.array([], pa.int32()), "id": rows["id"].slice(0, 0), "vector": pa.array([], pa.list_(pa.float64()))})
            cells = cells.sort_by([("cluster", "ascending"), ("ring", "ascending")])
            lo, hi, longest, n = (cells[c].to_numpy() for c in ("lo", "hi", "longest", "n"))
            row, cell = [], []
            for at in range(0, len(rows), 512):
                x = matrix(rows["vector"].slice(at, 512))
                away = _apart(x, matrix(cells["pivot"]))
                gap = np.maximum(0, np.maximum(away - hi, lo - away))
                least = np.clip(1 - (np.square(longest) + np.square(x).sum(1)[:, None] - np.square(gap)) / 2, 0, 2)
                # By bound, then by the nearness of the pivot; the cells before the one that holds the k-th row are met first.
                order = np.lexsort((away, least), axis=1)
                held = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(least.shape, dtype=bool)
                np.put_along_axis(first, order, held < k, axis=1)
                take = first if not later else ~first & (least <= rows["mark"].slice(at, 512).to_numpy()[:, None] + SLACK)
                i, j = np.nonzero(take)
                row.append(i + at)
                cell.append(j)
            row, cell = pa.array(np.concatenate(row)), pa.array(np.concatenate(cell))
            return pa.table({"cohort": rows["cohort"].take(row), "cluster": cells["cluster"].take(cell), "ring": cells["ring"].take(cell), "id": rows["id"].take(row), "vector": rows["vector"].take(row)})

        asked = left.select("cohort", "id", "vector")
        if later:
            asked = asked.join(marks, "id")
        met = _beside(_parts(asked, self.block), self.known)
        return met.applyInArrow(chosen, f"cohort string, cluster int, ring int, id {kind(left)}, vector array<double>")

    def search(self, targets: DataFrame, k: int) -> DataFrame:
        """The k best of each query and cell, in blocks of bounded size."""
        hits = targets.groupBy(*CELL).agg(F.ceil(F.count("*") / self.block).cast("int").alias("lefts"))
        sizes = self.known.select(*CELL, F.ceil(F.col("n") / self.block).cast("int").alias("rights")).join(hits, CELL)
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
        x = targets.join(sizes, CELL).withColumn("l", own("lefts")).withColumn("r", every("rights")).select(*CELL, "l", "r", F.col("id").alias("left_id"), F.col("vector").alias("left_vector"))
        y = self.rows.join(sizes, CELL).withColumn("r", own("rights")).withColumn("l", every("lefts"))
        y = y.select(*CELL, "l", "r", F.col("id").alias("right_id"), F.col("ordinal").alias("right_ordinal"), F.col("vector").alias("right_vector"))
        group = [*CELL, "l", "r"]
        found = x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(best_of(k), f"left_id {kind(targets)}, right_id {kind(self.rows)}, right_ordinal long, distance double")
        return merged(found, k)


def merged(partial: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with retrieval_rank; ties go to the lower ordinal."""
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy("distance", "right_ordinal"))
    return partial.withColumn("retrieval_rank", rank).where(F.col("retrieval_rank") <= k)


def pruned_topk(left: DataFrame, right: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest rows of ``right`` (cohort, id, ordinal, vector) in the cohort of each row of ``left`` (cohort, id, vector)."""
    cells = Cells(right, block)
    return merged(cells.best(settle(left.select("cohort", "id", "vector"), "queries"), k), k)
