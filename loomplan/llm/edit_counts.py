"""Edit-aware token counts: segment trees over runs of pre-tokens.

A document is cut where its pre-token pattern always cuts: before a single space or
newline that stands between two other characters, before a mark that follows a letter
or a number, and between an ASCII letter and a digit.  About ``LEAF`` code points make a leaf;
a segment tree over the leaves sums code points and tokens.  An edit descends the
tree to the leaves it touches, encodes those and one leaf of context on either side
anew, and updates the sums on the way up.

The leaves' lengths and counts are a document's state, a column that is kept with the
text.  ``count_tokens`` makes it; ``apply_edits`` takes it with edits and gives the new
text and state, and encodes only what the edits touch.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomplan.llm import bpe
from loomplan.llm.common import table

LEAF = 256
SAFE = re.compile(r"(?<=\S)[ \n](?=\S)|(?<=[^\W_])(?=[,.;:!?(){}=+*/&%#@~^\"，。、！？；：（）「」])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
EDITS = "array<struct<start:long,stop:long,text:string>>"
STATE = "struct<chars:array<int>,tokens:array<int>>"
COUNTS = "doc_id long, n_chars long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, encoded_chars long"


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """Runs of pre-tokens of at least ``size`` code points (the last may be shorter)."""
    out, at = [], 0
    while at + size < len(text):
        m = SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class SegmentTree:
    """Sums of code points and tokens over a document's leaves."""

    def __init__(self, text: str, count, size: int = LEAF, state: dict | None = None) -> None:
        self.count, self.size, self.encoded = count, size, 0
        if state is None:
            self._build(leaves_of(text, size))
            return
        ends = list(itertools.accumulate(state["chars"]))
        if (ends[-1] if ends else 0) != len(text):
            raise ValueError("the state is that of another text")
        self._build([text[e - n : e] for e, n in zip(ends, state["chars"])] or [""], list(state["tokens"]) or [0])

    @property
    def state(self) -> dict:
        """What ``state`` takes: the lengths and counts of the leaves that have text."""
        n, w = len(self.leaves), self.width
        kept = [i for i in range(n) if self.chars[w + i]]
        return {"chars": [self.chars[w + i] for i in kept], "tokens": [self.tokens[w + i] for i in kept]}

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(leaves):
            self.chars[self.width + i] = len(leaf)
            self.tokens[self.width + i] = self._encode(leaf) if tokens is None else tokens[i]
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` and its place there."""
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i] and i + 1 < 2 * self.width and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def edit(self, start: int, stop: int, text: str) -> None:
        """Put ``text`` in place of the code points [start, stop), both cut to the document."""
        n = self.chars[1]
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        a, _ = self._find(start)
        b, _ = self._find(stop)
        a, b = self._context(a, -1), self._context(b, 1)
        skipped = self._before(a)
        old = "".join(self.leaves[a : b + 1])
        new = old[: start - skipped] + text + old[stop - skipped :]
        parts = leaves_of(new, self.size)
        if len(parts) > b + 1 - a:
            # More leaves than places: the tree is laid out anew, with the counts it has.
            kept = self.tokens[self.width : self.width + len(self.leaves)]
            self._build(self.leaves[:a] + parts + self.leaves[b + 1 :], kept[:a] + [self._encode(p) for p in parts] + kept[b + 1 :])
            return
        for i in range(a, b + 1):
            leaf = parts[i - a] if i - a < len(parts) else ""
            self.leaves[i] = leaf
            self.chars[self.width + i], self.tokens[self.width + i] = len(leaf), self._encode(leaf)
        above = {(self.width + i) // 2 for i in range(a, b + 1)}
        while above and 0 not in above:
            for i in above:
                self._sum(i)
            above = {i // 2 for i in above}

    def _context(self, i: int, step: int) -> int:
        """One leaf further that has text: the cut beyond it doesn't feel the edit."""
        j = i + step
        while 0 <= j < len(self.leaves):
            if len(self.leaves[j]) > 1:
                return j
            j += step
        return min(max(j, 0), len(self.leaves) - 1)

    def _before(self, leaf: int) -> int:
        """Code points before a leaf."""
        i, out = self.width + leaf, 0
        while i > 1:
            if i & 1:
                out += self.chars[i - 1]
            i //= 2
        return out

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def _mapped(docs: DataFrame, names: list[str], fields: str, one, path: str | None) -> DataFrame:
    """``docs`` with the columns that ``one(count, *values of names)`` gives for each row."""
    vocabulary = path or bpe.vocabulary()
    new = StructType.fromDDL(fields)
    kept = [c for c in docs.columns if c not in new.names]
    schema = StructType([*docs.select(*kept).schema.fields, *new.fields])
    kinds = to_arrow_schema(new)
    at = [docs.columns.index(c) for c in names]
    keep = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.encoder(vocabulary).count
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out = [one(count, *(x.as_py() for x in values)) for values in zip(*(part.column(i) for i in at))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *(pa.array([row[j] for row in out], f.type) for j, f in enumerate(kinds))], names=schema.names)

    return docs.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, *, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Adds n_chars, n_tokens, n_leaves and state to ``docs`` (text); other columns pass through.

    Null text counts as empty.  Very long texts have many leaves, and only a run without
    any safe cut is one leaf.
    """

    def one(count, text: str | None) -> tuple:
        tree = SegmentTree(text or "", count, leaf)
        return tree.chars[1], tree.tokens[1], len(tree.leaves), tree.state

    return _mapped(docs, ["text"], f"n_chars long, n_tokens long, n_leaves long, state {STATE}", one, path)


def apply_edits(docs: DataFrame, *, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """New text, state, n_chars and n_tokens of ``docs`` (text, state, edits), and encoded_chars.

    ``edits``: array of start, stop, text, applied in order; offsets count code points of
    the text as edited so far and are cut to its ends.  ``encoded_chars``: how much the
    tokenizer read for them.  Null edits are none, a null replacement empty, a null offset
    0, a null state that of a text not counted yet.  Other columns pass through.
    """

    def one(count, text: str | None, state: dict | None, edits: list | None) -> tuple:
        tree = SegmentTree(text or "", count, leaf, state)
        for e in edits or []:
            if e is not None:
                tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
        return tree.text, tree.state, tree.chars[1], tree.tokens[1], tree.encoded

    return _mapped(docs, ["text", "state", "edits"], f"text string, state {STATE}, n_chars long, n_tokens long, encoded_chars long", one, path)


def edit_aware_counts(docs: DataFrame, *, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Token counts before and after the edits of each document, by ``count_tokens`` and ``apply_edits``.

    ``docs``: doc_id, text, edits.  ``encoded_chars`` is how much the edits made the
    tokenizer read.  Null text counts as empty, null edits as none, a null replacement as
    empty; a null offset as 0.  Rows are independent: repeated ids stay as they are, and
    an empty table gives no rows.  Extra columns are ignored, also those named as results.
    """
    counted = count_tokens(docs.select(F.col("doc_id").cast("long"), "text", F.col("edits").cast(EDITS)), path=path, leaf=leaf)
    edited = apply_edits(counted.withColumnsRenamed({"n_chars": "_chars", "n_tokens": "_tokens"}), path=path, leaf=leaf)
    return edited.select("doc_id", F.col("_chars").alias("n_chars"), F.col("_tokens").alias("n_tokens"), "n_leaves", F.col("n_chars").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), "encoded_chars")


def own_edits(docs: DataFrame) -> DataFrame:
    """Adds three edits that each text makes of itself: a replacement, a cut and an insertion.

    With n code points: [n/3, n/3 + 24) becomes the text's first 16; then 24 go
    at n/5; then the text's code points [n/4, n/4 + 40) come in at n/2.
    """
    n = F.length("text")
    at = lambda part: F.floor(n / part)
    piece = lambda start, length: F.substring(F.col("text"), start, length)
    one = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))
    return docs.withColumn(
        "edits",
        F.array(one(at(3), at(3) + 24, piece(F.lit(1), F.lit(16))), one(at(5), at(5) + 24, F.lit("")), one(at(2), at(2), piece(at(4).cast("int") + 1, F.lit(40)))),
    )


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: token counts of every document before and after three edits."""
    return edit_aware_counts(own_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
