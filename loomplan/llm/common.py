"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest value that fits a numpy unsigned 64-bit word.
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's folder inside the one that driver and executors share, ``spark.checkpoint.dir``.

    Only a local session without one (tests, a laptop) gets a temporary one; executors of
    a cluster couldn't see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-loomplan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/loomplan-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    The files outlive a lost executor, so later jobs never recompute what stands
    above the cut.  All of a session's are in one folder, which ``drop_cuts`` deletes.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete what this session's operators wrote for themselves; their results must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str | object, modulus: int, remainder: int):
    """Column: crc32 of the id as text falls on ``remainder``; a null id counts as ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(col.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus) == remainder


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned 64-bit words, one for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: ASCII white space ends a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, none for white space; and a random odd factor for each place in a word.
BYTE = np.where(SPACE, U64(0), scramble(np.arange(256), 1))
PLACES = 4096
PLACE = scramble(np.arange(PLACES), 2) | U64(1)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for every word of ``texts``, end to end, and each text's number of words."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
    if not len(starts):
        return np.zeros(0, dtype=U64), counts
    # Bytes before the first word are white space and weigh nothing.
    raw = raw[starts[0] :]
    spans = np.diff(np.append(starts, starts[0] + len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts - starts[0], spans)
    with np.errstate(over="ignore"):
        value = BYTE[raw] * PLACE[place & (PLACES - 1)]
        if (far := np.flatnonzero(place >= PLACES)).size:
            value[far] *= scramble(place[far] // PLACES, 4) | U64(1)
        return scramble(np.add.reduceat(value, starts - starts[0]), 3), counts


def shingle_codes(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A code for each run of ``width`` words in each text, in order, and how many each text has.

    A text of fewer words has one shingle, of all its words; a text of none has none.
    """
    n = len(codes)
    ends = np.cumsum(counts)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(width):
            part = np.zeros(n, dtype=U64)
            part[: max(0, n - i)] = codes[i:]
            out = (out ^ part) * U64(0x9FB21C651E98DF25)
            out ^= out >> U64(29)
        for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
            x = U64(int(counts[i]))
            for c in codes[ends[i] - counts[i] : ends[i]]:
                x = (x ^ c) * U64(0x9FB21C651E98DF25)
                x ^= x >> U64(29)
            out[ends[i] - counts[i]] = x
    # The first ``sizes`` places of each text are kept.
    place = np.arange(n) - np.repeat(ends - counts, counts)
    return out[place < np.repeat(sizes, counts)], sizes


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def portions(texts: list[bytes], most: int = 1_000_000):
    """(first, last + 1) of runs of texts with about ``most`` bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: The table of the CRC-32 of zlib, by its rule (reflected polynomial 0xEDB88320).
CRC_SQL = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) t(i)))"
