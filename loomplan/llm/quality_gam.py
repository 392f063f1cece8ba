"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; a lookup table for each feature, and for
each of a few pairs of features, gives an addition to the log-odds.  The tables are
learned by cyclic boosting: round after round, each feature in turn gets one
shallow tree fitted to what is left, damped by the learning rate, so that features
which move together share what they explain.  Pairs are chosen by the gain of one
tree over the residual, and boosted in turn the same way.  Scoring adds table
entries by bin, for all texts of a batch at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomplan.llm.common import cut, held_out, table

THRESHOLD = 0.7
#: Labelled rows learned from at most; chosen by a hash of the id.
MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, SMALLEST_LEAF = 150, 60, 0.15, 10

FEATURES = [
    "log_chars", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_next", "repeated_near",
    "upper", "digit", "stop", "comma", "symbol", "pipe", "exclaim", "non_ascii", "symbol_end", "mark_end", "title", "lines_a_word",
    "distinct_lines", "mean_line", "short_lines", "entropy", "mean_sentence", "url_like",
]
#: Byte classes of the character features.
UPPER, DIGIT, SYMBOL = (bytes(x) for x in (range(65, 91), range(48, 58), b"#$%&*+/<=>@[\\]^_`{|}~"))
MARK_END = re.compile(rb"[.!?](?=\s|\Z)")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; null as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [math.log1p(n), 0.0] + [0.0] * (len(FEATURES) - 2)
    count = Counter(words)
    kept = lambda table: (n - len(raw.translate(None, table))) / n
    lines = [x for x in raw.split(b"\n") if x]
    ends = Counter(x[-1] for x in words)
    sentences = len(MARK_END.findall(raw)) + 1
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    p = bytes_[bytes_ > 0] / n
    return [
        math.log1p(n), math.log1p(w), n / w, float(max(map(len, count))), len(count) / w, max(count.values()) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(bytes.__eq__, words, words[2:])) / w,
        kept(UPPER), kept(DIGIT), raw.count(b".") / w, raw.count(b",") / w, kept(SYMBOL), raw.count(b"|") / w, raw.count(b"!") / w, float(bytes_[128:].sum()) / n,
        sum(v for k, v in ends.items() if k in SYMBOL) / w, (ends[46] + ends[33] + ends[63] + ends[44]) / w, sum(map(bytes.istitle, words)) / w, len(lines) / w,
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)), float(-(p * np.log2(p)).sum()), w / sentences, (raw.count(b"://") + raw.count(b"www.")) / w,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the feature array of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Bin edges and tables.  Without training rows of both labels, the score is constant."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row: additions by bin."""
        z = np.full(len(x), self.start)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edge, x[:, j], side="right")]
        if self.pairs:
            b = [np.searchsorted(edge, x[:, j], side="right") for j, edge in enumerate(self.coarse)]
            for i, j, values in self.pairs:
                z += values[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins: values by bin."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            cg, ch, cn = (np.cumsum(v[a:b]) for v in (g, h, n))
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(cn[:-1] < SMALLEST_LEAF) | (cn[-1] - cn[:-1] < SMALLEST_LEAF)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (s, a + 1 + int(gain.argmax())))
        if best[1] is None:
            break
        s, at = best[1]
        a, b = spans[s]
        spans[s : s + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf tree over a grid, cut once on each axis: (gain, values)."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, values = 0.0, np.zeros_like(g)
    rows, columns = g.shape
    part = lambda c, a, b, i, j: c[b, j] - c[a, j] - c[b, i] + c[a, i]
    for r in range(1, rows):
        for c in range(1, columns):
            spans = [(a, b, i, j) for a, b in ((0, r), (r, rows)) for i, j in ((0, c), (c, columns))]
            sums = [(part(cg, *s), part(ch, *s)) for s in spans]
            gain = sum(x * x / (y + 1) for x, y in sums)
            if gain > best:
                best = gain
                values = np.zeros_like(g)
                for (a, b, i, j), (x, y) in zip(spans, sums):
                    values[a:b, i:j] = x / (y + 1)
    return best, values


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Learn tables from the rows of a bounded sample."""
    n = len(y)
    ones = float(y.sum())
    if not n or ones in (0.0, float(n)):
        return Model(start=math.log((ones + 1) / (n - ones + 1)))
    model = Model(start=math.log(ones / (n - ones)))
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    z = np.full(n, model.start)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(bins):
            g, h = residual()
            step = RATE * _tree(np.bincount(b, weights=g, minlength=len(sizes[j])), np.bincount(b, weights=h, minlength=len(sizes[j])), sizes[j])
            model.tables[j] += step
            z += step[b]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * width[j] + low[j], weights=v, minlength=width[i] * width[j]).reshape(width[i], width[j])

    g, h = residual()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(width)) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS if chosen else 0):
        for i, j, values in chosen:
            g, h = residual()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            values += step
            z += step[low[i], low[j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS) -> Model:
    """A model of ``labels.quality`` (0 or 1; other rows are left out) over the texts of ``docs``.

    Learns from at most ``most_rows`` labelled rows, those of least hash, and from one
    text for each, the least where an id has several; they and their texts' features are
    all that reaches the driver, so the bound holds for repeated rows of either table.
    Very long texts have features as any other.  Extra columns are ignored.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id", "y"), "doc_id").limit(most_rows)
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(cut(rows.distinct(), "labelled")), "doc_id")
    picked = picked.groupBy("doc_id", "y").agg(F.min("text").alias("text")).limit(most_rows)
    got = with_labels(picked)
    found = got.orderBy("doc_id", "y").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(found.column("x").to_pylist(), dtype=np.float64)
    return fit(x, found.column("y").to_numpy().astype(np.float64))


def with_labels(picked: DataFrame) -> DataFrame:
    """doc_id, y and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return picked.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>")


def quality_scores(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on) to ``docs``.

    Null and empty texts have features and a score as any other.  Rows are
    independent: ties and repeated rows score alike, and an empty table gives no
    rows.  Other columns pass through; score and predicted are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = sent.value.score(np.array([features(t.as_py()) for t in batch.column(at)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document scored; labels of remainder 2 of 4 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 4, 2)))
    scored = quality_scores(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
