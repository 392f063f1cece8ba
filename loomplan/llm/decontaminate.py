"""Benchmark items inside documents: size-partitioned MinHash containment search.

Plain MinHash estimates Jaccard similarity, which is tiny between a short item
and the long document that holds it.  So items are partitioned by size in
doubling classes, and for a class of at most ``u`` shingles each document is read
as windows of ``2 u`` shingles that overlap by half.  A run of shingles as long as
the item lies whole in some window, so a contained item of more than ``FEW`` shingles
has a Jaccard similarity of about a fifth at least with that window, however long the
document is.  One equal minimum of ``HASHES`` makes a candidate.  An item of at most
``FEW`` shingles is a candidate wherever any of them stands, by exact look-up.
Candidates are verified by exact containment of the item's word shingles in the whole
document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import U64, lowered, portions, scramble, shingle_codes, table, word_codes

WIDTH, THRESHOLD = 5, 0.8
HASHES = 32
#: The smallest size class, and up to how many shingles an item is looked up by each of them.
LEAST, FEW = 16, 8
#: Items, and bytes of their texts, in a block on average: an index of one block is sent to the tasks.
BLOCK, BLOCK_BYTES = 20_000, 8_000_000
NONE = U64(2**64 - 1)
#: Fixed for each hash function: what is xored in, and the odd factor.
XORS, FACTORS = scramble(np.arange(HASHES), 11), scramble(np.arange(HASHES), 12) | U64(1)
HITS = "doc_id long, item_id long, n_shared int, n_item int, containment double"


def size_class(n: int) -> int:
    """The least doubling of ``LEAST`` that holds ``n`` shingles."""
    u = LEAST
    while u < n:
        u *= 2
    return u


def exact_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The word shingles themselves; a text of fewer words has one, of all its words."""
    w = text.split()
    if not w:
        return set()
    width = min(width, len(w))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


class Index:
    """Minima of a block of items, by size class and hash function."""

    def __init__(self, items: list[tuple[int, bytes]], width: int) -> None:
        self.width = width
        self.items: list[tuple[int, set]] = []
        #: Items of at most ``FEW`` shingles: by the number of words of a shingle, code to items.
        self.short: dict[int, dict[int, list[int]]] = {}
        minima: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            codes, counts = word_codes([text])
            if not len(codes):
                continue
            k = len(self.items)
            self.items.append((item_id, exact_shingles(text, width)))
            n = int(counts[0])
            shingles, _ = shingle_codes(codes, counts, min(n, width))
            if len(shingles) <= FEW:
                own = self.short.setdefault(min(n, width), {})
                for code in set(shingles.tolist()):
                    own.setdefault(code, []).append(k)
                continue
            with np.errstate(over="ignore"):
                low = ((shingles[None, :] ^ XORS[:, None]) * FACTORS[:, None]).min(axis=1)
            minima[size_class(len(shingles))].append((k, low))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for u, rows in sorted(minima.items()):
            own = np.array([k for k, _ in rows])
            low = np.stack([m for _, m in rows])
            self.classes[u] = []
            for j in range(HASHES):
                order = np.argsort(low[:, j], kind="stable")
                gate = np.zeros(1 << 16, dtype=bool)
                gate[low[:, j] >> U64(48)] = True
                self.classes[u].append((low[order, j], own[order], gate))

    def candidates(self, codes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs with an equal minimum in some window, or any shingle of a short item."""
        found: set[tuple[int, int]] = set()
        shingles, sizes = shingle_codes(codes, counts, self.width)
        for n, items in self.short.items():
            runs, run_sizes = (shingles, sizes) if n == self.width else shingle_codes(codes, np.where(counts >= n, counts, 0), n) if (counts >= n).all() else self._runs(codes, counts, n)
            where = np.flatnonzero(np.isin(runs, np.fromiter(items, dtype=U64)))
            if len(where):
                text = np.repeat(np.arange(len(counts)), run_sizes)
                found.update((int(text[i]), k) for i in where.tolist() for k in items[int(runs[i])])
        if not self.classes:
            return found
        least, most = min(self.classes), max(self.classes)
        # Each text starts a block of the largest class and ends with an empty block of it.
        padded = (sizes // most + 2) * most
        starts = np.cumsum(padded) - padded
        row = np.full(int(padded.sum()), NONE)
        real = np.zeros(len(row), dtype=bool)
        at = np.arange(len(shingles)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        row[at], real[at] = shingles, True
        text_of = np.repeat(np.arange(len(counts)), padded // least)
        gap = ~real
        for j in range(HASHES):
            with np.errstate(over="ignore"):
                h = (row ^ XORS[j]) * FACTORS[j]
            h[gap] = NONE
            low, u = h.reshape(-1, least).min(axis=1), least
            while u <= most:
                if u in self.classes:
                    values, items, gate = self.classes[u][j]
                    window = np.minimum(low[:-1], low[1:])
                    where = np.flatnonzero(gate[window >> U64(48)])
                    if len(where):
                        a, b = (np.searchsorted(values, window[where], side=s) for s in ("left", "right"))
                        for i in np.flatnonzero(b > a).tolist():
                            text = int(text_of[where[i] * (u // least)])
                            found.update((text, int(k)) for k in items[a[i] : b[i]])
                low, u = np.minimum(low[0::2], low[1::2]) if u < most else low, u * 2
        return found

    @staticmethod
    def _runs(codes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of ``n`` words of the texts that have as many."""
        kept = counts >= n
        runs, sizes = shingle_codes(codes[np.repeat(kept, counts)], counts[kept], n)
        out = np.zeros(len(counts), dtype=sizes.dtype)
        out[kept] = sizes
        return runs, out


def item_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """(item_id, text) of the items in blocks that are bounded in rows and in bytes.

    A block holds one item at least, so a single text beyond ``BLOCK_BYTES`` is a block by itself.
    """
    items = items.select(F.col("item_id").cast("long"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r["item_id"], lowered(r["text"])) for r in items.where(part == b).orderBy("item_id", "text").toLocalIterator()]


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row for each document and item of which it holds ``threshold`` of the shingles or more.

    ``docs``: doc_id, text; ``items``: item_id, text.  Shingles are runs of
    ``width`` words of the lower-cased text; an item of fewer words counts as one
    shingle of all its words, found as such a run.  n_shared / n_item is the exact
    containment.  Null and empty texts hold nothing, and empty items are in
    nothing.  Very long texts are read as windows and whole.  Repeated rows give
    repeated hits, and null ids stay null.  Items are taken in blocks bounded in rows
    and bytes, each sent to the tasks; extra columns are ignored.
    """
    out = None
    for rows in item_blocks(items, block):
        sent = docs.sparkSession.sparkContext.broadcast(Index(rows, width))
        hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_searcher(sent, threshold), HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def without_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, by the rule of ``contained_items``.

    Each row is judged by its own text, so repeated and null ids don't matter; all
    columns pass through.
    """
    names, at = docs.columns, docs.columns.index("text")
    for rows in item_blocks(items, block):
        sent = docs.sparkSession.sparkContext.broadcast(Index(rows, width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, dtype=bool)
                for i, *_ in _hits(sent.value, [lowered(t.as_py()) for t in batch.column(at)], threshold):
                    stays[i] = False
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _hits(index: Index, texts: list[bytes], threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item_id, shared, size of the item) of the candidates that exact containment confirms."""
    for a, b in portions(texts):
        codes, counts = word_codes(texts[a:b])
        by_text: dict[int, list[int]] = defaultdict(list)
        for i, k in sorted(index.candidates(codes, counts)):
            by_text[a + i].append(k)
        for i, found in by_text.items():
            own: dict[int, set] = {}
            for k in found:
                item_id, shingles = index.items[k]
                n = min(index.width, len(next(iter(shingles))))
                if n not in own:
                    w = texts[i].split()
                    own[n] = {tuple(w[x : x + n]) for x in range(len(w) - n + 1)}
                shared = len(shingles & own[n])
                if shared >= threshold * len(shingles):
                    yield i, item_id, shared, len(shingles)


def _searcher(sent, threshold: float):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    names = [c.split()[0] for c in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [lowered(t.as_py()) for t in batch.column(1)]
            rows = [(ids[i], item_id, shared, n, shared / n) for i, item_id, shared, n in _hits(sent.value, texts, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return run


def op4_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every benchmark item against every whole document."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::INT AS n_shared, any_value(n)::INT AS n_item, count(*)::DOUBLE / any_value(n) AS containment
FROM shingles i JOIN shingles d ON i.kind = 'i' AND d.kind = 'd' AND i.s = d.s JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n)
"""
