"""Packed token-id matrices: ids, cumulative segment lengths and position resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm import bpe
from loomplan.llm.common import cut, table
from loomplan.llm.packing import CAPACITY, best_fit_decreasing, tokenize_pieces

#: Open pieces in a group on average, at most one for each document; with 8 KB of ids each a group stays under 20 MB.
GROUP = 2_500
NAMES = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "pieces", "position_ids"]
KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
SEQUENCES = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, position_ids binary"


def position_ids(cu_seqlens: list[int], capacity: int) -> np.ndarray:
    """0, 1, 2, ... in every segment, from 0 again at each start; the padding is one more segment."""
    at = np.arange(capacity)
    starts = np.asarray(cu_seqlens[:-1] + ([cu_seqlens[-1]] if cu_seqlens[-1] < capacity else []), dtype=np.int64)
    return (at - starts[np.searchsorted(starts, at, side="right") - 1]).astype("<u4")


def packed_sequences(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, pad_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row for each packed sequence of ``capacity`` ids.

    ``ids``: the row of the id matrix, little-endian unsigned 32 bit, padded with
    ``pad_id`` beyond ``n_tokens``.  ``cu_seqlens``: 0 and the end of each segment.
    ``position_ids``: positions that restart with every segment.  ``doc_ids`` and
    ``pieces`` name the segments, so every document can be put together again.

    Pieces of the whole capacity are sequences by themselves and aren't moved; only a
    document's first piece can be shorter, so what is dealt to groups, by row, is at most
    one piece a document, however long it is and whatever its id.  Each group is packed
    in one task by best-fit decreasing.  Null and empty texts are the end id alone; rows
    that repeat, also those of one id or of none, are packed as often as they stand
    there; equal lengths keep no order; an empty table gives no rows.  Extra columns are
    ignored.
    """
    groups = max(1, -(-docs.count() // group))
    # Written once for both ways; ids that fit take two bytes.
    pieces = cut(_narrowed(tokenize_pieces(docs, path=path or bpe.vocabulary(), capacity=capacity, end_id=end_id, with_ids=True)), "token-pieces")
    pad = int(pad_id).to_bytes(4, "little")

    def sequence(number: int, ids: list[bytes], doc_ids: list, pieces: list[int]) -> tuple:
        rows = [_widened(x) for x in ids]
        cu = [0, *np.cumsum([len(x) // 4 for x in rows]).tolist()]
        return number, cu[-1], b"".join(rows) + pad * (capacity - cu[-1]), cu, doc_ids, pieces, position_ids(cu, capacity).tobytes()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                number, doc_id, piece, ids = (c.to_pylist() for c in batch.slice(at, 500).columns)
                rows = [sequence(-1 - n, [x], [d], [p]) for n, d, p, x in zip(number, doc_id, piece, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    whole = pieces.where(F.col("length") >= capacity).select(F.monotonically_increasing_id().alias("number"), "doc_id", "piece", "ids").mapInArrow(alone, SEQUENCES)
    open_ = pieces.where(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(t: pa.Table) -> pa.Table:
        bins, offsets = best_fit_decreasing(t["length"].to_numpy(), capacity)
        order = np.lexsort((offsets, bins))
        ids, doc_ids, nth = (t[c].take(pa.array(order)).to_pylist() for c in ("ids", "doc_id", "piece"))
        starts = np.flatnonzero(np.diff(bins[order], prepend=-1)).tolist()
        g = t["_group"][0].as_py() << 24
        rows = [sequence(g + b, ids[s:e], doc_ids[s:e], nth[s:e]) for b, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)

    return whole.unionByName(open_.groupBy("_group").applyInArrow(pack, SEQUENCES))


def _narrowed(pieces: DataFrame) -> DataFrame:
    """``ids`` with two bytes an id and a leading byte 2 where all of a piece's ids fit, otherwise four and 4."""
    names, at = pieces.columns, pieces.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at):
                ids = np.frombuffer(x.as_py(), dtype="<u4")
                out.append(b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.binary()), *batch.columns[at + 1 :]], names=names)

    return pieces.mapInArrow(run, pieces.schema)


def _widened(ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


def write_packed(sequences: DataFrame, path: str) -> None:
    """Write sequences as Parquet; an id matrix of a file is its ``ids`` column end to end."""
    sequences.write.mode("overwrite").parquet(path)


def unpack(sequences: DataFrame) -> DataFrame:
    """(doc_id, piece, ids) of every segment: the inverse of packing."""
    seg = F.posexplode(F.arrays_zip("doc_ids", "pieces"))
    return (
        sequences.select("ids", "cu_seqlens", seg.alias("i", "seg"))
        .select(F.col("seg.doc_ids").alias("doc_id"), F.col("seg.pieces").alias("piece"), "ids", F.get("cu_seqlens", F.col("i")).alias("a"), F.get("cu_seqlens", F.col("i") + 1).alias("b"))
        .select("doc_id", "piece", F.expr("substring(ids, 4 * a + 1, 4 * (b - a))").alias("ids"))
    )


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document in packed rows; digests of the matrices."""
    packed = packed_sequences(table(spark, sf_dir, "documents"))
    return packed.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
