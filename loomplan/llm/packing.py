"""Best-fit packing of tokenised documents into sequences of fixed capacity.

``bound_certified_pack`` packs in rounds.  Each round deals the open pieces to
groups of bounded size and packs every group by best-fit decreasing.  A lower
bound from dual feasible functions certifies a group's number of sequences.
Groups that meet their bound are done; a group with a gap keeps its full
sequences and gives up the rest, which the groups exchange and repack in the
next round.  A round's packing replaces the last one only where it needs fewer
sequences, so the count never grows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm import bpe
from loomplan.llm.common import cut, table

CAPACITY = 2048
#: Pieces dealt to one group at most, on average; a group is packed in one task.
GROUP = 5_000
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_spans(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, *, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids, then ``end_id``; null text counts as empty.

    Columns: doc_id, piece, start, length, ids_crc32, and ids (binary, unsigned
    32-bit) if asked for.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                view = memoryview(ids)
                for k, (start, length) in enumerate(piece_spans(len(ids) // 4, capacity)):
                    part = view[4 * start : 4 * (start + length)]
                    out.append((doc_id, k, start, length, zlib.crc32(part)) + ((bytes(part),) if with_ids else ()))
                    size += len(part) * with_ids
                if size > 16_000_000:
                    yield _batch(out, with_ids)
                    out, size = [], 0
            if out:
                yield _batch(out, with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + ([pa.binary()] if with_ids else [])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.  Longest first; each goes to the fullest bin that holds it.

    A segment tree over the room left (leaf r: how many bins have r left) finds
    the smallest room of at least the length in log2(capacity) steps.  Equal
    lengths keep their order.
    """
    leaves = 1 << int(capacity).bit_length()
    tree = [0] * (2 * leaves)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(room: int, by: int) -> None:
        at = room + leaves
        while at:
            tree[at] += by
            at >>= 1

    def smallest(least: int) -> int:
        at = least + leaves
        if tree[at]:
            return least
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < leaves:
                    at *= 2
                    if not tree[at]:
                        at += 1
                return at - leaves
            at >>= 1
        return -1

    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = smallest(length)
        if room < 0:
            b, room = opened, capacity
            opened += 1
        else:
            b = rooms[room].pop()
            add(room, -1)
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        rooms[left].append(b)
        add(left, 1)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by three families of dual feasible functions.

    Each maps a length to a weight such that the weights in a bin sum to at most
    one: plain shares; for a threshold, items over capacity - t count whole and
    those under t not at all; and rounded shares floor((k+1)x)/k.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        whole, part = sizes > capacity - t, (sizes >= t) & (sizes <= capacity - t)
        best = max(best, int(counts[whole].sum()) + -(-int((sizes[part] * counts[part]).sum()) // capacity))
    for k in range(1, 65):
        share = (k + 1) * sizes
        weight = np.where(share % capacity == 0, sizes * k, (share // capacity) * capacity)
        best = max(best, -(-int((weight * counts).sum()) // (capacity * k)))
    return best


def _packer(capacity: int, r: int):
    """What packs one group in round ``r``."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        full = np.bincount(bins, weights=lengths, minlength=count) == capacity
        g, n = t["_group"][0].as_py(), len(t)
        new = {"sequence_id": (r << 58) + (g << 24) + bins, "offset": offsets, "round": np.full(n, r, dtype=np.int32), "group_bound": np.full(n, bound, dtype=np.int64), "closed": full[bins] | (count <= bound)}
        t = t.drop_columns(["_group"])
        for name, values in new.items():
            t = t.append_column(name, pa.array(values))
        return t

    return pack


def bound_certified_pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS, key: str | None = None) -> DataFrame:
    """Give every piece a sequence_id and an offset in it.

    Pieces of the whole capacity are sequences by themselves and are not moved.
    Sequence ids are (round, group, number) in one long.  Adds ``sequence_id``,
    ``offset``, ``round`` and ``group_bound`` (what certifies the group's count;
    null for whole pieces).  An empty table gives an empty result.  ``pieces``
    needs lengths of 1 to ``capacity``; other columns pass through unchanged.
    Repeated rows are packed as often as they stand there.  ``key``: a column that tells
    rows apart, by which they are dealt; otherwise (doc_id, piece).
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "round", "group_bound")]
    pieces = pieces.select(*names)
    dealt_by = F.xxhash64(key) if key else F.xxhash64("doc_id", "piece")
    whole = pieces.where(F.col("length") >= capacity).select(
        *names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("round"), F.lit(None).cast("long").alias("group_bound"))
    open_ = pieces.where(F.col("length") < capacity)
    done, before, kept = [whole], None, None
    schema = pieces.schema.simpleString()[7:-1] + ", sequence_id long, offset long, round int, group_bound long, closed boolean"
    for r in range(rounds):
        left = open_.count()
        if not left:
            break
        groups = -(-left // group)

        dealt = open_.withColumn("_group", F.pmod(F.xxhash64(dealt_by, F.lit(r)), F.lit(groups)))
        packed = cut(dealt.groupBy("_group").applyInArrow(_packer(capacity, r), schema), f"pack-{r}")
        if kept is not None and packed.select("sequence_id").distinct().count() >= before:
            break  # the last round's sequences for these pieces are at least as few
        done.append(packed.where("closed").drop("closed"))
        kept = packed.where("not closed").drop("closed")
        before = kept.select("sequence_id").distinct().count()
        open_ = kept.select(*names)
    if kept is not None:
        done.append(kept)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack the pieces; one row for each piece.

    Null and empty texts are one piece of the end id alone.  Very long texts are
    cut into pieces without loss.  Rows that repeat are packed as often as they
    stand there; ties in length keep doc_id order.  Extra columns are ignored.
    """
    pieces = tokenize_pieces(docs, path=path or bpe.vocabulary(), capacity=capacity, end_id=end_id)
    # Numbered as they are written, so that rows of one id are dealt like others.
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return bound_certified_pack(pieces, capacity=capacity, group=group, rounds=rounds, key="_row").drop("_row")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document packed into sequences of 2048 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
