"""Maximal periodic runs of words, found by uniting suffix classes in order of falling LCP.

A run is a stretch of words with smallest period q and a length of at least 2q that
neither neighbour extends.  Its start s and s + q share length - q >= q words.  Suffixes
are united by the longest common prefix (LCP) of neighbours in suffix order, longest
first; each class keeps its positions in order.  Two positions that become neighbours
when classes unite at LCP L, at a distance d <= L, have the period d over d + L words, and
no smaller one: a position between them would otherwise be of their class.  If the words
before them differ too, that is a whole run, and every run is found so, once.  Smaller
classes go into larger ones, so uniting takes O(n log n) steps in a document of n words;
before it, suffixes are sorted once for each doubling of the longest repeat.

Runs of at least ``LEAST`` words have L >= LEAST / 2, so a document in which no stretch
of LEAST / 2 words repeats has none; most end there, on arrays of whole batches.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import CRC_SQL, portions, shingle_codes, table, word_codes

#: Words of the shortest run.
LEAST = 12
#: Positions in a chunk of a large class.
CHUNK = 2_048


class Positions:
    """Positions in order, in chunks, so that adding one to very many moves few."""

    __slots__ = ("chunks", "lows", "size")

    def __init__(self, first: int):
        self.chunks, self.lows, self.size = [[first]], [first], 1

    def around(self, x: int) -> tuple[int, int]:
        """The largest position under ``x`` and the smallest over it; -1 where there is none."""
        at = max(bisect_left(self.lows, x) - 1, 0)
        chunk = self.chunks[at]
        k = bisect_left(chunk, x)
        over = chunk[k] if k < len(chunk) else self.lows[at + 1] if at + 1 < len(self.lows) else -1
        return (chunk[k - 1] if k else -1), over

    def add(self, x: int) -> None:
        at = max(bisect_left(self.lows, x) - 1, 0)
        chunk = self.chunks[at]
        chunk.insert(bisect_left(chunk, x), x)
        self.lows[at] = chunk[0]
        self.size += 1
        if len(chunk) > CHUNK:
            self.chunks[at : at + 1] = [chunk[: CHUNK // 2], chunk[CHUNK // 2 :]]
            self.lows[at : at + 1] = [chunk[0], chunk[CHUNK // 2]]

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of ``ids`` in order, and the LCP of each with the one before it (the first: 0)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(steps)))
        width *= 2
        if steps.all():
            break
        levels.append(rank)
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        # A rank says that 2**k words agree, or that both suffixes end: different suffixes end apart.
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        lcp[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start, then period."""
    order, lcp = suffix_order(ids)
    wanted = np.flatnonzero(lcp >= max(1, -(-least // 2)))
    wanted = wanted[np.argsort(-lcp[wanted], kind="stable")]
    place, common, words = order.tolist(), lcp.tolist(), ids.tolist()
    root: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def top(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    def seed(i: int, j: int, shared: int) -> None:
        if j - i <= shared and j - i + shared >= least and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, j - i + shared, j - i))

    for k in wanted.tolist():
        shared, a, b = common[k], top(k - 1), top(k)
        large, small = classes.pop(a, None) or Positions(place[a]), classes.pop(b, None) or Positions(place[b])
        if large.size < small.size:
            large, small = small, large
        # Neighbours are looked up among the large class alone; one of the small class between two ends their being neighbours.
        last, sides = -1, [(x, *large.around(x)) for x in small]
        for (x, under, over), (after, *_) in pairwise([*sides, (len(words), 0, 0)]):
            if under > last:
                seed(under, x, shared)
            if 0 <= over < after:
                seed(x, over, shared)
            last = x
        for x, *_ in sides:
            large.add(x)
        root[b] = a
        classes[a] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays: those of a run after its first period go."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original number of each of ``n`` words, where the hash of the id (one in ten) has a document repeat from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return out


def repeats(codes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which texts have a stretch of ``width`` words twice."""
    shingles, sizes = shingle_codes(codes, counts, width)
    owner = np.repeat(np.arange(len(counts)), sizes)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    again = (shingles[1:] == shingles[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=len(counts)) > 0


def word_runs(docs: DataFrame, *, least: int = LEAST, plant: bool = False) -> DataFrame:
    """doc_id, runs and collapsed text of every row of ``docs`` (doc_id, text), and the longest run.

    ``runs``: (start, length, period) by start, then period, of stretches of words (ended
    by ASCII white space, numbered from 0, told apart by case) with a smallest period
    that fits twice and at least ``least`` words.  ``longest``: the run of greatest
    length, of equal ones that of smallest start, then period; null without runs.
    ``collapsed``: the words that no run contains after its first period, joined by one
    space.  ``plant``: read the texts with repeats planted by the hash of their ids.

    Null, empty and blank texts have no words, no runs and an empty collapsed text.
    A null doc_id is a row like others, never planted.  Repeated rows give repeated
    results.  Very long texts are read whole, each in one task: a million
    words took one second where nothing repeats and twelve to seventeen where all does.  An empty
    table gives no rows; extra columns are ignored, also those named as the results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            for a, b in portions(texts):
                runs, kept = [], []
                codes, counts = word_codes(texts[a:b])
                parts = np.split(codes, np.cumsum(counts)[:-1])
                orders = [planted(n, i) if plant else None for i, n in zip(ids[a:b], counts.tolist())]
                parts = [p if o is None else p[o] for p, o in zip(parts, orders)]
                again = repeats(np.concatenate(parts), counts, max(1, -(-least // 2)))
                for text, part, order, may in zip(texts[a:b], parts, orders, again.tolist()):
                    found, words = runs_of(part, least) if may else [], text.split()
                    if order is not None:
                        words = [words[k] for k in order.tolist()]
                    if found:
                        words = [words[k] for k in np.flatnonzero(collapsed(len(words), found)).tolist()]
                    runs.append(found)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    first = lambda a, b: F.when(a["length"] != b["length"], a["length"] > b["length"]).when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] <= b["period"])
    longest = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda best, x: F.when(first(best, x), best).otherwise(x))
    return found.select("doc_id", "runs", longest.alias("longest"), "collapsed")


def digests(runs: DataFrame) -> DataFrame:
    """``word_runs`` as counts, the longest run and hashes."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    exponent = F.floor(F.col("longest.length") * 1000 / F.col("longest.period"))
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        exponent.cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: periodic runs of all documents, with the repeats that their ids plant."""
    return digests(word_runs(table(spark, sf_dir, "documents"), plant=True))


OP12_SQL = f"""
WITH {CRC_SQL}, split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h
  FROM documents, crc
), sizes AS (
  SELECT doc_id, coalesce(v, []) AS v, coalesce(len(v), 0) AS n, CASE WHEN h % 10 = 0 THEN h // 10 END AS g FROM split
), places AS (
  SELECT *, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM sizes
), docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN v ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN v[i + 1] ELSE v[1 + a + (i - a) % p] END) END AS w FROM places
), grams AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM docs WHERE n > 5)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 AS shared FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs) GROUP BY doc_id, q, part
), runs AS MATERIALIZED (
  SELECT doc_id, start, shared + q AS length, min(q) AS period FROM stretches WHERE shared >= q AND shared + q >= 12 GROUP BY 1, 2, 3
), best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'x': -length, 'y': start, 'z': period}}) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
