"""Spelling variants of the words of a corpus, by PartEnum signatures of letter multisets.

A word's letters are a set of (letter, occurrence number), a binary vector.  One inserted
or deleted letter changes one element, one replaced letter two, so near words are vectors
at a Hamming distance of at most two.  The elements are dealt to ``PARTS`` parts; two
differences touch at most two of them, so near words agree on all of at least one choice
of PARTS - 2 parts.  Each word has one signature for each choice (15 of four parts out of
six), words of one signature and of equal or neighbouring length are joined, and each
pair is verified by its edit distance.  Nothing is lost: hash collisions only add pairs
to verify.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import CRC_SQL, U64, cut, scramble, table

#: Letters: after lower-casing A-Z, what U+00C0 to U+00FF holds counts as letters too.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Shortest words and least occurrences.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form is at least.
FACTOR = 5
PARTS = 6
#: One occurrence in so many, by the hash of id and word, has a planted slip.
SLIPS = 199
#: Different words that a task holds before it hands their counts on.
HELD = 200_000


def slipped(doc_id: int, counts: Counter[str]) -> Counter[str]:
    """``counts`` of one document, where words whose hash with its id is a multiple of ``SLIPS`` lack one letter."""
    start, out = zlib.crc32(b"%d:" % doc_id), Counter()
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), start)
        if h % SLIPS == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def corpus_words(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, plant: bool = False) -> DataFrame:
    """word, n: runs of letters of all texts of ``docs`` (doc_id, text), A-Z lower-cased, and how often they stand there.

    Only words of ``least_length`` code points and ``least_count`` occurrences or more.
    Null and empty texts have none; a null doc_id is a document like others, without
    planted slips.  Repeated rows count as often as they stand there.  Tasks count first,
    so a word travels once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = LETTERS.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if plant and doc_id is not None:
                    found = slipped(doc_id, Counter(found))
                held.update(found)
                if len(held) > HELD:
                    yield _counted(held, least_length)
                    held = Counter()
        yield _counted(held, least_length)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(counts: Counter[str], least_length: int) -> pa.RecordBatch:
    kept = {w: n for w, n in counts.items() if len(w) >= least_length}
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])


def signatures(words: list[str], parts: int = PARTS) -> np.ndarray:
    """One row for each word: a 64-bit hash for each choice of ``parts`` - 2 parts of its letter multiset."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, owner))
    letters, owner = letters[order], owner[order]
    # The occurrence number of a letter: its distance from the first equal one.
    first = np.ones(len(letters), dtype=bool)
    first[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(letters))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    sums = np.zeros(len(words) * parts, dtype=U64)
    with np.errstate(over="ignore"):
        np.add.at(sums, owner * parts + (letters + nth) % parts, scramble((letters << 32) | nth, 1))
        sums = scramble(sums, 2).reshape(-1, parts)
        out = []
        for c, chosen in enumerate(combinations(range(parts), parts - 2)):
            key = np.full(len(words), scramble(np.array([c]), 3)[0], dtype=U64)
            for p in chosen:
                key = scramble(key ^ sums[:, p], 4)
            out.append(key)
    return np.stack(out, axis=1)


def near_words(words: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """a, b: every two of the different ``words`` (word) that one inserted, deleted or replaced code point makes equal.

    Each pair stands there once; of two of unequal length ``a`` is the shorter one, of
    others the smaller.  Words of one signature meet in a join, whose large keys Spark
    splits; more ``parts`` make more signatures and smaller groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                keys = signatures(part.column(0).to_pylist(), parts).view(np.int64)
                of = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(keys.ravel())], names=["word", "size", "key"])

    known = words.select("word", F.length("word").alias("size")).where(F.col("word") != "")
    signed = cut(known.mapInArrow(run, "word string, size int, key long"), "spelling-signatures")
    left = signed.select(F.col("word").alias("a"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), "key", F.col("size").alias("own"))
    right = signed.select(F.col("word").alias("b"), "size", "key")
    ordered = (F.col("own") < F.col("size")) | (F.col("a") < F.col("b"))
    near = left.join(right, ["key", "size"]).where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "b").distinct()


def spelling_forms(words: DataFrame, *, factor: int = FACTOR, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n; words are different).

    ``form``: of the words near to it the most frequent one (of equally frequent ones the
    smallest by code points) if that is at least ``factor`` times as frequent, else null;
    ``form_n``: how often that is.  ``root``: what following forms ends at, the word
    itself without one; each step is ``factor`` times as frequent, so the way is short.
    ``n_near``: how many words are near.

    A null or empty word is near to nothing.  An empty table gives no rows; extra columns
    are ignored.
    """
    words = words.select("word", "n")
    pairs = cut(near_words(words, parts=parts), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = both.join(known, "other").groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    is_form = F.col("form_n") >= factor * F.col("n")
    found = cut(found.select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")

    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    out = found.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: forms and roots of all words of at least six letters and five occurrences, with planted slips."""
    words = cut(corpus_words(table(spark, sf_dir, "documents"), plant=True), "words")
    return spelling_forms(words)


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL}, found AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents
  ) GROUP BY 1, 2
), hashed AS (
  SELECT w, k, xor(list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x) - 64] END)),
    lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h
  FROM found, crc
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, 2 + h % length(w)) ELSE w END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5
), cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT near.word, near.other, o.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, near.other) AS place
  FROM near JOIN words o ON o.word = near.other
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT chain.word, forms.form, steps + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY 1) r ON r.word = f.word
"""
