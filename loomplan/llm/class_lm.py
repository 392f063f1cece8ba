"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Training counts cover every word of every training text.  Words whose share of all
training tokens is ``UNIT_SHARE`` or more (so at most 1 / UNIT_SHARE) are units:
exchange clustering moves them, and ``STRATA`` strata of the other words by their
last two bytes, between ``CLASSES`` classes while the likelihood of the class bigrams
grows.  Then every other word of the training vocabulary moves from its stratum's
class to the one that fits its own neighbours best, with the strata's units as a
prior.  Only a word that training never saw takes the class of its stratum.

    P(text) = product of P(class | class before) * P(word | class)

Transitions are counted anew from all training texts in the final classes and smoothed
towards class shares.  Words in a class have absolute discounting, which leaves the
discounted mass to the class's one event "any unseen word".  Both sum to one, so with
those events they give a distribution over the V seen tokens and the unseen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomplan.llm.common import cut, held_out, lowered, portions, table

CLASSES, STRATA, ITERATIONS = 64, 256, 5
#: Shares of all training tokens from which a word is a unit, and from which tasks know its count.
UNIT_SHARE, KNOWN_SHARE = 5e-5, 2e-6
#: Weight of the class shares in a transition, and of a stratum in the class of its words, in words.
PRIOR, STRATUM_WEIGHT = 20.0, 2.0
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
END = b"\n"  # no word has white space


def stratum(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % STRATA


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the words of all texts, and the end token once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0):
                held.update(lowered(text.as_py()).split())
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Words that tasks know: at most 1 / KNOWN_SHARE of them, with their counts and units."""

    ids: dict[bytes, int]
    counts: np.ndarray
    unit: np.ndarray
    n_units: int

    def lookup(self) -> "Lookup":
        return Lookup(self.ids)


class Lookup(dict):
    """Word to its number; a word that is not known to -1 - stratum."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-2:]) % STRATA


def known_units(counts: DataFrame, total: int, unit_share: float, known_share: float) -> Units:
    """Unit 0 is the end, then the frequent words, the rest of the places are strata."""
    rows = counts.where((F.col("n") >= max(1.0, known_share * total)) & (F.col("word") != F.lit(END))).orderBy(F.desc("n"), "word").toArrow()
    found = list(zip(rows["word"].to_pylist(), rows["n"].to_pylist()))
    frequent = sum(n >= unit_share * total for _, n in found)
    unit = np.array([k + 1 if k < frequent else 1 + frequent + stratum(w) for k, (w, _) in enumerate(found)], dtype=np.int64)
    return Units({w: k for k, (w, _) in enumerate(found)}, np.array([n for _, n in found], dtype=np.int64), unit, 1 + frequent + STRATA)


def _unit_rows(texts: list[bytes], look: Lookup, unit: np.ndarray, n_units: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, their numbers, each text's number of words, and units with the end after each text."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.split()
        words += own
        sizes.append(len(own))
    ids = np.fromiter(map(look.__getitem__, words), dtype=np.int64, count=len(words))
    units = np.where(ids >= 0, unit[np.maximum(ids, 0)] if len(unit) else 0, n_units - STRATA - 1 - ids)
    size = np.array(sizes, dtype=np.int64)
    with_end = np.zeros(len(words) + len(texts), dtype=np.int64)
    with_end[np.arange(len(words)) + np.repeat(np.arange(len(texts)), size)] = units
    return words, ids, size, with_end


def unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u; every text starts after an end."""
    sent = texts.sparkSession.sparkContext.broadcast((units.ids, units.unit, units.n_units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, n_units = sent.value
        look = Lookup(ids)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, n = keys[first], np.add.reduceat(n, first)
            held[:] = []
            return pa.RecordBatch.from_arrays([pa.array(keys // n_units), pa.array(keys % n_units), pa.array(n)], names=["u", "v", "n"])

        for batch in batches:
            raw = [lowered(t.as_py()) for t in batch.column(0)]
            for a, b in portions(raw, 4_000_000):
                row = _unit_rows(raw[a:b], look, unit, n_units)[3]
                before = np.concatenate(([0], row[:-1]))
                keys, n = np.unique(before * n_units + row, return_counts=True)
                held.append((keys, n.astype(np.int64)))
                size += len(keys)
                if size > 2_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of class bigram counts, up to what no exchange changes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def best_class(m: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float) -> int:
    """Where a unit of class ``a`` goes; takes it out of ``m`` and puts it back there.

    right, left: how often classes follow and precede the unit, apart from itself; own: after itself.
    """
    m[a, :] -= right
    m[:, a] -= left
    m[a, a] -= own
    rows, columns = m.sum(axis=1), m.sum(axis=0)
    gain = (_xlogx(m + right[None, :]) - _xlogx(m)).sum(axis=1) + (_xlogx(m + left[:, None]) - _xlogx(m)).sum(axis=0)
    d = np.diagonal(m)
    gain += _xlogx(d + right + left + own) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
    gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(columns + left.sum() + own) - _xlogx(columns)
    gain[0] = -np.inf  # the end's own class
    b = int(gain.argmax())
    if gain[b] <= gain[a] + 1e-9:
        b = a
    m[b, :] += right
    m[:, b] += left
    m[b, b] += own
    return b


def class_bigrams(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """The k by k matrix of class bigram counts."""
    sent = pairs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        m = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            u, v, n = (x.to_numpy() for x in batch.columns)
            np.add.at(m, c[u] * k + c[v], n)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], names=["cell", "n"])

    return _matrix(pairs.mapInArrow(run, "cell long, n long"), k)


def _matrix(cells: DataFrame, k: int) -> np.ndarray:
    """Sums of (cell, n) as a k by k matrix: at most 65,536 rows, fetched by one job."""
    sums = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(k, k)


def exchange_clustering(pairs: DataFrame, n_units: int, *, k: int = CLASSES, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts).

    In a round each task moves its share of the units one by one against its own
    copy of the class counts; between rounds the counts are made anew from all
    pairs.  The best round's classes stay.  A unit's row holds at most two
    entries for each other unit.
    """
    spark = pairs.sparkSession
    classes = np.array([0] + [1 + i % (k - 1) for i in range(n_units - 1)], dtype=np.int64)
    sides = pairs.select(F.col("u").alias("unit"), F.lit(1).alias("right"), F.col("v").alias("other"), "n").unionByName(pairs.select(F.col("v").alias("unit"), F.lit(0).alias("right"), F.col("u").alias("other"), "n"))
    rows = sides.where("unit <> 0").groupBy("unit").agg(F.collect_list("right").alias("right"), F.collect_list("other").alias("other"), F.collect_list("n").alias("n"))
    rows = cut(rows, "adjacency")
    m = class_bigrams(pairs, classes, k)
    best = (likelihood(m), classes, m)
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast((classes, m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own_classes, own_m = sent.value[0].copy(), sent.value[1].copy()
            for batch in batches:
                moved = []
                units = batch.column(0).to_pylist()
                for u, right, other, n in zip(units, batch.column(1), batch.column(2), batch.column(3)):
                    right, other, n = (x.values.to_numpy() for x in (right, other, n))
                    self_n = float(n[(other == u) & (right == 1)].sum())
                    others = other != u
                    r, l = (np.bincount(own_classes[other[others & (right == side)]], weights=n[others & (right == side)], minlength=k) for side in (1, 0))
                    own_classes[u] = best_class(own_m, int(own_classes[u]), r, l, self_n)
                    moved.append(int(own_classes[u]))
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(moved, pa.int32())], names=["unit", "class"])

        now = classes.copy()
        moves = rows.mapInArrow(run, "unit long, class int").toArrow()
        now[moves["unit"].to_numpy()] = moves["class"].to_numpy()
        if (now == classes).all():
            break
        classes = now
        m = class_bigrams(pairs, classes, k)
        if (score := likelihood(m)) > best[0]:
            best = (score, classes, m)
    return best[1], best[2]


def word_code(word: bytes) -> int:
    """64 bits that stand for a word where its contexts are gathered."""
    x = xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def contexts(texts: DataFrame, units: Units, class_of: np.ndarray, k: int) -> DataFrame:
    """(code, stratum, context, n): the classes before and after each word that is no unit, as before * k + after."""
    sent = texts.sparkSession.sparkContext.broadcast((units.ids, units.unit, units.n_units, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, unit, n_units, classes = sent.value
        look, first_stratum = Lookup(ids_of), n_units - STRATA
        codes_of = np.fromiter(map(word_code, ids_of), dtype=np.int64, count=len(ids_of))
        strata_of = np.fromiter(map(stratum, ids_of), dtype=np.int32, count=len(ids_of))
        held: list[np.ndarray] = []

        def batch_of(codes: np.ndarray, strata: np.ndarray, around: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(strata.astype(np.int32)), pa.array(around.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "stratum", "context", "n"])

        def known() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            own = keys // (k * k)
            return batch_of(codes_of[own], strata_of[own], keys % (k * k), n)

        for batch in batches:
            raw = [lowered(t.as_py()) for t in batch.column(0)]
            for a, b in portions(raw, 4_000_000):
                words, ids, size, row = _unit_rows(raw[a:b], look, unit, n_units)
                c = classes[row]
                place = np.arange(len(words)) + np.repeat(np.arange(b - a), size)
                around = np.append(0, c)[place] * k + c[place + 1]  # each text starts after an end
                tail = row[place] >= first_stratum
                here = np.flatnonzero(tail & (ids >= 0))
                held.append(ids[here] * (k * k) + around[here])
                rare = np.flatnonzero(tail & (ids < 0))
                if len(rare):
                    codes = np.fromiter((word_code(words[i]) for i in rare.tolist()), dtype=np.int64, count=len(rare))
                    yield batch_of(codes, -1 - ids[rare], around[rare], np.ones(len(rare)))
                if sum(map(len, held)) > 4_000_000:
                    yield known()
        if held:
            yield known()

    return texts.select("text").mapInArrow(run, "code long, stratum int, context int, n long")


def tail_classes(found: DataFrame, step: np.ndarray, column: np.ndarray, prior: np.ndarray) -> DataFrame:
    """(code, class): for each word the class that its contexts and the prior of its stratum make likeliest.

    ``found``: code, context, n and stratum, one shuffle by code.  A word's contexts are
    summed over a window of rows of its code, so a task never holds more than one batch
    and the word at its end.
    """
    k = len(column)
    sent = found.sparkSession.sparkContext.broadcast((step, np.log10(np.maximum(column, 1.0)), prior))
    rows = found.repartition("code").sortWithinPartitions("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_step, log_size, log_prior = sent.value
        open_code, open_counts, open_stratum = None, np.zeros(2 * k), 0

        def best(codes: np.ndarray, counts: np.ndarray, strata: np.ndarray) -> pa.RecordBatch:
            left, right = counts[:, :k], counts[:, k:]
            value = left @ own_step + right @ own_step.T - left.sum(axis=1)[:, None] * log_size + log_prior[strata]
            value[:, 0] = -np.inf  # the end's own class
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(value.argmax(axis=1).astype(np.int32))], names=["code", "class"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                code, around, n, strata = (x.to_numpy() for x in batch.slice(at, 4096).columns)
                first = np.flatnonzero(np.diff(code, prepend=code[0] - 1 if code[0] > -(2**63) else code[0] + 1))
                place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
                cells = np.concatenate([place * 2 * k + around // k, place * 2 * k + k + around % k])
                counts = np.bincount(cells, weights=np.concatenate([n, n]), minlength=len(first) * 2 * k).reshape(len(first), 2 * k)
                codes, own = code[first], strata[first]
                if open_code is not None:
                    if codes[0] == open_code:
                        counts[0] += open_counts
                    else:
                        codes, own, counts = np.append(open_code, codes), np.append(open_stratum, own), np.vstack([open_counts[None], counts])
                open_code, open_counts, open_stratum = codes[-1], counts[-1], own[-1]
                if len(codes) > 1:
                    yield best(codes[:-1], counts[:-1], own[:-1])
        if open_code is not None:
            yield best(np.array([open_code]), open_counts[None], np.array([open_stratum]))

    return rows.mapInArrow(run, "code long, class int")


def transitions(classed: DataFrame, k: int) -> np.ndarray:
    """The k by k matrix of class bigram counts of the texts that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            c = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), dtype=np.uint8).astype(np.int64)
            if len(c):
                m += np.bincount(np.append(0, c[:-1]) * k + c, minlength=k * k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], names=["cell", "n"])

    return _matrix(classed.where("learns").select("classes").mapInArrow(run, "cell long, n long"), k)


@dataclass
class Vocabulary:
    """What tasks know of words: those of ``Units`` with their classes, and the rest by class."""

    units: Units
    classes: np.ndarray
    stratum_class: np.ndarray
    #: log10 of a class's tokens, and of its unseen event's share.
    log_size: np.ndarray
    unseen: np.ndarray
    discount: float


def classed_texts(rows: DataFrame, v: Vocabulary, rest: DataFrame, total: int, distinct: int, ends: int) -> DataFrame:
    """doc_id, learns, asked, n_tokens, n_known, base, emission and classes (a byte for each token) of every row.

    ``rows``: doc_id, text, learns, asked; ``rest``: word, n, class of the words that tasks
    don't know.  Only tokens of those are shuffled, each with its text's number and its
    place, and come back to their text with what the join gave.
    """
    space = float(total + distinct + 1)
    unit = v.units
    inner = np.log10(np.maximum(unit.counts - v.discount, 1e-9)) - v.log_size[v.classes] if len(unit.counts) else np.zeros(0)
    base = np.log10((unit.counts + 1) / space)
    sent = rows.sparkSession.sparkContext.broadcast((unit.ids, v.classes, inner, base))
    base_end, known_end = float(np.log10((ends + 1) / space)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, classes, inner, base = sent.value
        look = Lookup(ids_of)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw = [lowered(t.as_py()) for t in batch.column(1)]
            for a, b in portions(raw, 4_000_000):
                tokens, ids, size, _ = _unit_rows(raw[a:b], look, classes, STRATA + 1)
                known = ids >= 0
                text = np.repeat(np.arange(b - a), size)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                at = ids[known]
                sums = lambda x: np.bincount(text[known], weights=x, minlength=b - a)
                own = np.where(known, classes[np.maximum(ids, 0)] if len(classes) else 0, 0).astype(np.uint8)
                ends_ = np.cumsum(size)
                strings = [own[e - s : e].tobytes() + b"\x00" for s, e in zip(size.tolist(), ends_.tolist())]
                rare = np.flatnonzero(~known)
                numbers = np.arange(row, row + b - a)
                row += b - a
                n, r = b - a, len(rare)
                # A text's own row has a key that no word can be.
                keys = [b" %d" % x for x in numbers.tolist()] + [tokens[i] for i in rare.tolist()]
                both = lambda x, kind: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind), pa.nulls(r, kind)])
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([numbers, numbers[text[rare]]])), pa.array(keys, pa.binary()), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(place[rare].astype(np.int32))]),
                     pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array((-1 - ids[rare]).astype(np.int32))]), both(part.column(0), pa.int64()), both(part.column(2), pa.bool_()), both(part.column(3), pa.bool_()),
                     both(size + 1, pa.int64()), both(sums(None).astype(np.int64) + known_end, pa.int64()), both(sums(base[at]) + base_end, pa.float64()), both(sums(inner[at]), pa.float64()), both(strings, pa.binary())],
                    names=["row", "word", "place", "stratum", "doc_id", "learns", "asked", "n_tokens", "n_known", "base", "emission", "classes"])

    schema = "row long, word binary, place int, stratum int, doc_id long, learns boolean, asked boolean, n_tokens long, n_known long, base double, emission double, classes binary"
    scored = rows.select(F.col("doc_id").cast("long"), "text", "learns", "asked").mapInArrow(run, schema)
    of = lambda values, at: F.get(F.lit([float(x) for x in values]), at)
    rare, seen = F.col("place").isNotNull(), F.col("c").isNotNull()
    own = F.coalesce(F.col("class"), F.get(F.lit([int(x) for x in v.stratum_class]), F.col("stratum")))
    emission = F.when(seen, F.log10(F.greatest(F.col("c") - F.lit(v.discount), F.lit(1e-9))) - of(v.log_size, own)).otherwise(of(v.unseen, own))
    terms = scored.join(rest.select("word", F.col("n").alias("c"), "class").hint("merge"), "word", "left").select(
        "row", "doc_id", "learns", "asked", "n_tokens", F.when(rare, seen.cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rare, F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(space))).otherwise(F.col("base")).alias("base"),
        F.when(rare, emission).otherwise(F.col("emission")).alias("emission"), "classes",
        # The place and the class of a token in one number.
        F.when(rare, F.col("place").cast("long") * 256 + own).alias("token"))
    first = [F.max(c).alias(c) for c in ("doc_id", "learns", "asked", "n_tokens", "classes")]
    sums = [F.sum(c).alias(c) for c in ("n_known", "base", "emission")]
    texts = terms.groupBy("row").agg(*first, *sums, F.collect_list("token").alias("tokens")).drop("row")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [x.as_py() for x in batch.column(4)]
            lists = batch.column(8)
            sizes = np.array([len(x) for x in strings], dtype=np.int64)
            whole = np.frombuffer(b"".join(strings), dtype=np.uint8).copy()
            tokens = lists.flatten().to_numpy()
            starts = np.repeat(np.cumsum(sizes) - sizes, lists.value_lengths().to_numpy())
            whole[starts + tokens // 256] = tokens % 256
            parts = [x.tobytes() for x in np.split(whole, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *batch.columns[5:8], pa.array(parts, pa.binary())], names=["doc_id", "learns", "asked", "n_tokens", "n_known", "base", "emission", "classes"])

    return texts.mapInArrow(fill, "doc_id long, learns boolean, asked boolean, n_tokens long, n_known long, base double, emission double, classes binary")


def fit_and_score(docs: DataFrame, train: DataFrame | Column, *, classes: int = CLASSES, iterations: int = ITERATIONS, unit_share: float = UNIT_SHARE, known_share: float = KNOWN_SHARE) -> DataFrame:
    """Learn from ``train`` (a table with text, or a condition on ``docs``) and score ``docs`` (doc_id, text).

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score and
    perplexity (10 to the power of -score / n_tokens), one row for each row of
    ``docs``.  Words are cut at ASCII white space and A-Z lower-cased; a text is its
    words and one end, so null and empty texts are the end alone.  With no
    training text every token is unseen, at log10 probability 0 for base and
    score.  Repeated rows are counted and scored as often as they stand there, also
    those of one id or of none; equal texts score alike.  Very long texts are rows
    like others: a byte a token comes together in one place.  Ties between classes
    go to the lower number.  Extra columns are ignored, also those named as results.

    Tasks know the counts of words from ``known_share`` of all tokens on, at most
    1 / known_share; other words are shuffled to their counts, and none of those
    is frequent.
    """
    if not 2 <= classes <= 256:
        raise ValueError("classes must be 2 to 256")
    spark = docs.sparkSession
    condition = train if isinstance(train, Column) else F.lit(False)
    rows = docs.select("doc_id", "text", F.coalesce(condition, F.lit(False)).alias("learns"), F.lit(True).alias("asked"))
    if not isinstance(train, Column):
        rows = rows.unionByName(train.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("learns"), F.lit(False).alias("asked")))
    texts = rows.where("learns").select("text")

    counts = cut(token_counts(texts), "word-counts")
    total, distinct, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    units = known_units(counts, total, unit_share, known_share)
    k, n_units = classes, units.n_units
    pairs = cut(unit_pairs(texts, units), "unit-pairs")
    class_of, m = exchange_clustering(pairs, n_units, k=k, iterations=iterations)
    first_stratum = n_units - STRATA

    # Every other word to the class that its own contexts make likeliest.
    step = np.log10(smoothed(m))
    kinds = np.full((STRATA, k), 1e-3)
    kinds[np.arange(STRATA), class_of[first_stratum:]] += STRATUM_WEIGHT
    for word, i in units.ids.items():
        if units.unit[i] < first_stratum:
            kinds[stratum(word), class_of[units.unit[i]]] += 1
    prior = np.log10(kinds / kinds.sum(axis=1, keepdims=True))
    tail = counts.where((F.col("n") < max(1.0, unit_share * total)) & (F.col("word") != F.lit(END)))
    tail = cut(with_codes(tail), "tail")
    found = contexts(texts, units, class_of, k).groupBy("code", "context").agg(F.sum("n").alias("n"), F.max("stratum").alias("stratum"))
    moved = tail_classes(found.select("code", "context", "n", "stratum"), step, m.sum(axis=0), prior)
    tail = cut(tail.join(moved.hint("merge"), "code").select("word", "n", "stratum", "class"), "tail-classes")

    # Tokens and distinct words of each class: units here, all others from their table.
    own_class = np.array([class_of[u] for u in units.unit], dtype=np.int64) if len(units.unit) else np.zeros(0, dtype=np.int64)
    is_unit = units.unit < first_stratum
    size, kinds_in = np.zeros(k), np.zeros(k)
    np.add.at(size, own_class[is_unit], units.counts[is_unit])
    np.add.at(kinds_in, own_class[is_unit], 1)
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        size[r["class"]] += r["n"]
        kinds_in[r["class"]] += r["kinds"]
    # Unseen words of a stratum: where most of its once-seen words are.
    stratum_class = class_of[first_stratum:].copy()
    best = tail.where("n = 1").groupBy("stratum", "class").count().groupBy("stratum").agg(F.max_by(F.col("class"), F.struct(F.col("count"), -F.col("class"))).alias("class"))
    for r in best.collect():
        stratum_class[r["stratum"]] = r["class"]
    known = tail.where(F.col("n") >= max(1.0, known_share * total))
    of_known = known.select("word", "class").toArrow()
    own_class[[units.ids[w] for w in of_known["word"].to_pylist()]] = of_known["class"].to_numpy()
    discount = once / (once + 2.0 * twice) if once and twice else 0.5
    with np.errstate(divide="ignore"):
        unseen_share = np.where(kinds_in > 0, np.log10(discount * kinds_in / np.maximum(size, 1)), 0.0)
    words = Vocabulary(units, own_class, stratum_class, np.log10(np.maximum(size, 1)), unseen_share, float(discount))

    rest = tail.where(F.col("n") < max(1.0, known_share * total)).select("word", "n", "class")
    ends = int(counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    classed = cut(classed_texts(rows, words, rest, total, distinct, ends), "classed")
    step = np.log10(smoothed(transitions(classed, k))) if total else np.zeros((k, k))
    sent = spark.sparkContext.broadcast(step)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [x.as_py() for x in batch.column(7)]
            if not strings:
                continue
            c = np.frombuffer(b"".join(strings), dtype=np.uint8)
            starts = np.cumsum([0] + [len(x) for x in strings[:-1]])
            # A text ends with the end's class 0, and so each starts after one.
            moves = np.add.reduceat(sent.value[np.append(0, c[:-1]), c], starts)
            emission = batch.column(6).to_numpy() if total else np.zeros(len(strings))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(moves + emission)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = classed.where("asked").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def smoothed(m: np.ndarray) -> np.ndarray:
    """Transition probabilities of class bigram counts, drawn to the class shares."""
    column = m.sum(axis=0)
    share = (column + 1) / (column.sum() + len(m))
    return (m + PRIOR * share[None, :]) / (m.sum(axis=1)[:, None] + PRIOR)


def with_codes(words: DataFrame) -> DataFrame:
    """(word, n, code, stratum) of (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([word_code(w) for w in own], pa.int64()), pa.array([stratum(w) for w in own], pa.int32())], names=["word", "n", "code", "stratum"])

    return words.select("word", "n").mapInArrow(run, "word binary, n long, code long, stratum int")


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document scored; those of remainder 2 of 7 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = fit_and_score(docs, ~held_out("doc_id", 7, 2))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
