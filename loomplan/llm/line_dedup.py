"""Exact removal of lines that repeat across documents.

One pass over the text gives each task's line hashes, dealt to ranges.  In each range
two Bloom filters, of a size that its hashes give, hold what one document has and what
a second has; what is in the second is suspected.  The suspected hashes fill one filter
that tasks get, if it stays under ``MOST_BITS``, and otherwise are joined.  A second pass
hands on only lines that may be suspected, by a digest of 128 bits, to be counted
exactly and to choose the last document.  The filters only choose what is shuffled:
what they hold wrongly costs traffic, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomplan.llm.common import cut, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter for each hash, and the most of the filter that is sent to tasks (16 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: A filter that is sent is made and merged in slices of so many bits.
SLICE = 1 << 18
#: Documents for each range of hashes.
DOCS_A_RANGE = 20_000
#: Hashes that a task gathers before it hands them on.
HELD = 2_000_000


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """Lines, and each line's key, or None where the key is shorter than ``min_chars`` code points."""
    lines = (text or "").split("\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = None
        if len(line) >= min_chars:
            key = line.encode("utf-8", "surrogatepass").strip().lower()
            if len(key) < min_chars or len(key.decode("utf-8", "surrogatepass")) < min_chars:
                key = None
        keys.append(key)
    return lines, keys


class TwoFilters:
    """Bloom filters of keys seen once and seen again, with two probes a key."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)

    @staticmethod
    def probes_of(h: np.ndarray, bits: int) -> np.ndarray:
        return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])

    def probes(self, h: np.ndarray) -> np.ndarray:
        return self.probes_of(h, self.bits)

    @staticmethod
    def holds(bits: np.ndarray, probes: np.ndarray) -> np.ndarray:
        return ((bits[probes >> np.uint64(3)] >> (probes & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def put(bits: np.ndarray, probes: np.ndarray) -> None:
        flat = probes.ravel()
        np.bitwise_or.at(bits, flat >> np.uint64(3), np.left_shift(1, (flat & np.uint64(7))).astype(np.uint8))

    def add_part(self, seen: np.ndarray, again: np.ndarray) -> None:
        """A task's distinct hashes, and those of them that two of its documents have."""
        p = self.probes(seen)
        self.put(self.twice, p[:, self.holds(self.once, p)])
        self.put(self.twice, self.probes(again))
        self.put(self.once, p)


def _hashes(keys: set[bytes]) -> list[int]:
    return list(map(xxh3_64_intdigest, keys))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def power(n: int) -> int:
    """The least power of two that is ``n`` or more."""
    return 1 << max(0, n - 1).bit_length()


def suspected_hashes(docs: DataFrame, *, min_chars: int = MIN_CHARS, docs_a_range: int = DOCS_A_RANGE) -> DataFrame:
    """(hash) of the line keys that two documents may share.

    A task hands on each of its hashes once, so a line of very many documents is no more
    rows in its range than there are tasks.
    """
    ranges = power(-(-docs.count() // docs_a_range))
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            of = (h >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(h), dtype=np.int64)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            parts = [(h[x:y].tobytes(), h[x:y][n[x:y] > 1].tobytes()) for x, y in zip(starts, [*starts[1:], len(h)])]
            return pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], names=["range", "seen", "again"])

        for batch in batches:
            own: list[int] = []
            for text in batch.column(0):
                own += _hashes({k for k in line_keys(text.as_py(), min_chars)[1] if k is not None})
            if own:
                found.append(np.array(own, dtype=np.uint64))
            if sum(map(len, found)) > HELD:
                yield out()
        if found:
            yield out()

    def suspects(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["seen"].map(len).to_numpy() // 8
        both = TwoFilters(power(max(1024, BITS_A_KEY * int(sizes.sum()))))
        for seen, again in zip(pdf["seen"], pdf["again"]):
            both.add_part(np.frombuffer(seen, dtype=np.uint64), np.frombuffer(again, dtype=np.uint64))
        held = [h[both.holds(both.twice, both.probes(h))] for h in (np.frombuffer(x, dtype=np.uint64) for x in pdf["seen"])]
        return pd.DataFrame({"hash": np.unique(np.concatenate(held)).view(np.int64)})

    partial = docs.select("text").mapInArrow(fill, "range long, seen binary, again binary")
    return partial.groupBy("range").applyInPandas(suspects, "hash long")


def filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """One Bloom filter of ``bits`` bits that holds the hashes, made in slices by tasks."""
    probes = F.array(*[F.shiftright("hash", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(min(SLICE, bits), dtype=np.uint8)
        own[pdf["place"].to_numpy() % SLICE] = 1
        return pd.DataFrame({"slice": [int(pdf["place"].iloc[0]) // SLICE], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    places = hashes.select(F.explode(probes).alias("place")).groupBy(F.floor(F.col("place") / SLICE)).applyInPandas(fill, "slice long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in places.toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        out[row["slice"] * SLICE // 8 : row["slice"] * SLICE // 8 + len(part)] = part
    return out


def suspected_lines(docs: DataFrame, hashes: DataFrame, *, min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, doc_id) of every suspected key of a document, as a digest."""
    bits = power(max(1024, BITS_A_KEY * hashes.count()))
    small = bits <= most_bits
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(hashes, bits)) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            ids: list[int | None] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {k for k in line_keys(text.as_py(), min_chars)[1] if k is not None}
                keys += own
                ids += [doc_id] * len(own)
            h = np.array(_hashes(keys), dtype=np.uint64)
            kept = np.flatnonzero(TwoFilters.holds(sent.value, TwoFilters.probes_of(h, bits))) if small else np.arange(len(h))
            yield pa.RecordBatch.from_arrays([pa.array([digest(keys[i]) for i in kept], pa.binary()), pa.array([ids[i] for i in kept], pa.int64()), pa.array(h[kept].view(np.int64))], names=["key", "doc_id", "hash"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long, hash long")
    if not small:
        # Written, so that the rows of a hot line can be split.
        found = cut(found, "line-hashes").join(hashes, "hash", "left_semi")
    return found.select("key", "doc_id")


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to ``docs`` (doc_id, text).

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case.  Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose all their lines but those in the largest doc_id
    that holds them.  Null or empty text is one empty line.  Rows of one doc_id
    count as one document and are treated alike; a row with a null id counts as
    no document and never keeps such a line.  Very long texts are read whole, and a
    document has a row for each of its lost lines.  An empty table gives no rows.
    Other columns pass through; n_lines, n_dropped and kept_text are replaced.
    ``bits``: the most bits of the filter that tasks get, ``MOST_BITS`` otherwise.
    """
    hashes = cut(suspected_hashes(docs, min_chars=min_chars), "suspected-hashes")
    suspects = cut(suspected_lines(docs, hashes, min_chars=min_chars, most_bits=MOST_BITS if bits is None else bits), "suspects")
    counted = suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    # Written, so that the join meets plain rows on both sides and the rows of a hot line can be split.
    counted = cut(counted, "repeated-lines")
    lost = suspects.join(counted, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lists = cut(lost.groupBy(F.col("doc_id").alias("_lost_id")).agg(F.collect_set("key").alias("_lost")), "lost-lines")

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    # Merged at every size, as the lists of a large table are no small side.
    joined = docs.select(*names).join(lists.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_lost_id")), "left")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, lost in zip(batch.column(at), batch.column(len(names) + 1)):
                text, gone = text.as_py() or "", set(lost.as_py() or ())
                if not gone:
                    total.append(text.count("\n") + 1)
                    dropped.append(0)
                    kept.append(text)
                    continue
                lines, keys = line_keys(text, min_chars)
                stay = [line for line, key in zip(lines, keys) if key is None or digest(key) not in gone]
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_text"])

    schema = docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return joined.mapInArrow(run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document without its repeated lines, as a digest."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), gone AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT lines.*, gone.k IS NOT NULL AND doc_id <> keep AS dropped FROM lines LEFT JOIN gone USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
