"""Document fingerprints by order MinHash, in DataFrame functions only.

The letters are words, cut at ASCII white space; runs of more than ``LONGEST`` code points
without any, as in scripts without spaces, are cut further by what they hold: after each
character beyond ASCII, after certain ASCII ones, and else after ``LONGEST``, so that an edit
moves no cut far from it.  A k-mer is a word with the one that follows.  A repeated k-mer counts by its occurrence number, so the
multiset, not the set, is sampled.  One hash of (k-mer, occurrence) deals them to
``BINS`` bins; each bin keeps its ``TUPLE`` smallest, puts them back in text
order and hashes the tuple.  Moved text thus changes a fingerprint where a plain
MinHash would not, as edit distance does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.llm.common import cut, table

#: 2**6 bins; the bin is the top of a 63-bit value: 35 bits of hash, 28 of position.  A
#: text has fewer words than 2**28, as an array of more longs isn't possible.
BIN_BITS, PLACE_BITS = 6, 28
#: Code points of a word that is cut no further, and where longer ones are.
LONGEST = 32
CUTS = r"(?<=[^\x00-\x7F])|(?<=[aeiouAEIOU0-3,;:(){}\[\]<>/+=_.-])|(?<=\G.{32})"
#: Documents in a range of neighbouring ids on average; and equal rows that are written out together.
BUCKET, CHUNK = 100_000, 10_000


def _words(text: Column) -> Column:
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    parts = F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(F.filter(F.split(w, CUTS), lambda p: p != ""))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONGEST), parts).otherwise(words)


def _packed(code: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(code, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(place)


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<int>, one entry (bin, 16-bit tuple hash) for each bin that has k-mers.

    Null text has no k-mers.  The steps are columns of their own, so that none is
    evaluated again for each element of an array.
    """
    w, s, t, e = (f"_{out}_{x}" for x in "wste")
    word, k, o = F.col(w), F.col(s), F.col(t)
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    kmer = lambda x: F.shiftright(x, PLACE_BITS)
    bin_ = lambda x: F.shiftright(x, 63 - BIN_BITS)
    df = df.withColumn(w, _words(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(s, F.sort_array(F.transform(word, lambda x, i: _packed(F.xxhash64(x, F.coalesce(F.get(word, i + 1), F.lit(""))), F.least(i.cast("long"), mask)))))

    def occurrence(x: Column, i: Column) -> Column:
        """How many equal k-mers stand before place i of the sorted array: doubling steps back."""
        steps = F.array(*[F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)])
        return F.aggregate(steps, F.lit(1), lambda n, step: F.when((i - n - step >= 0) & (kmer(F.get(k, i - n - step)) == kmer(x)), n + step).otherwise(n))

    repeated = lambda x, i: (i > 0) & (kmer(F.get(k, i - 1)) == kmer(x))
    df = df.withColumn(t, F.sort_array(F.transform(k, lambda x, i: F.when(repeated(x, i), _packed(F.xxhash64(kmer(x), occurrence(x, i)), x.bitwiseAND(mask))).otherwise(x))))
    # The two smallest of each bin: TUPLE = 2.
    df = df.withColumn(e, F.filter(o, lambda x, i: (i < 2) | (bin_(F.get(o, i - 2)) != bin_(x))))
    two = F.col(e)

    def entry(x: Column, i: Column) -> Column:
        y = F.get(two, i + 1)
        pair = F.when(y.isNull() | (bin_(y) != bin_(x)), F.xxhash64(kmer(x))).when(x.bitwiseAND(mask) < y.bitwiseAND(mask), F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        first = (i == 0) | (bin_(F.get(two, i - 1)) != bin_(x))
        return F.when(first, F.shiftleft(bin_(x), 16).bitwiseOR(F.shiftrightunsigned(pair, 48)).cast("int"))

    df = df.withColumn(out, F.array_compact(F.transform(two, entry)))
    return df.drop(w, s, t, e)


def fingerprint(signature: Column) -> Column:
    """The signature as a string of six hexadecimal digits an entry."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins used by either text in which both have the same tuple; 1 for two texts without words."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, key: str, columns: list[str], *, bucket: int = BUCKET, heads: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows in ascending ``key``; the first follows the last.

    A null key comes first.  Rows of one key go by the first code points of the first
    column, then by its hash; the other columns follow from that column.  The result has
    ``key`` and ``columns``.  heads: of such a column, only as many first code points as the
    row before asks for travel to it.

    Places are found from keys and hashes alone, in ranges of about ``bucket`` rows, so a key
    that repeats with many texts is spread over tasks.  Rows of one key and text are
    counted before they are shuffled, and follow each other; one task writes them out again,
    row by row.
    """
    heads, content = heads or {}, F.col(columns[0])
    by = ["_key", "_a", "_b"]
    keyed = docs.select(key, *columns, F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_key"),
        F.xxhash64(F.col(key).isNull(), content).alias("_a"), F.xxhash64(F.lit("second"), content).alias("_b"))
    order = ["_key", "_head", "_a", "_b"]
    asks = {c: f"_ask_{c}" for c in heads}
    narrow = keyed.select("_key", F.substring(content.cast("string"), 1, 32).alias("_head"), "_a", "_b", *[heads[c].alias(name) for c, name in asks.items()])
    portions = max(1, -(-docs.count() // bucket))
    placed = cut(narrow.distinct().repartitionByRange(portions, *order).withColumn("_portion", F.spark_partition_id()), "places")
    # One row for each of the ``portions`` tasks.
    firsts = placed.groupBy("_portion").agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.select("_portion", F.coalesce(F.lead("_first").over(Window.orderBy("_portion")), F.min("_first").over(Window.partitionBy())).alias("_after"))
    following = F.coalesce(F.lead(F.struct(*order)).over(Window.partitionBy("_portion").orderBy(*order)), F.col("_after"))
    steps = placed.join(F.broadcast(firsts), "_portion").withColumn("_next", following)
    steps = steps.select(*[F.col(f"_next.{c}").alias(c) for c in by], *[F.col(c).alias(f"{c}_to") for c in by], *asks.values())
    whole = keyed.groupBy(*by).agg(*[F.first(c).alias(c) for c in columns], F.count("*").alias("_n"), F.count(key).alias("_ids"))
    # Both sides of the join read all columns of ``whole``, so that Spark shuffles it once for both.
    whole = whole.where(F.col("_n") + F.col("_ids") > 0)
    given = [F.substring(F.col(c), F.lit(1), F.col(asks[c])) if c in asks else F.col(c) for c in columns]
    gifts = whole.join(steps, by).select(*[F.col(f"{c}_to").alias(c) for c in by], *[g.alias(f"next_{c}") for g, c in zip(given, columns)])
    out = whole.join(gifts, by)
    # Of n equal rows all but the last are followed by one like themselves.
    out = out.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    out = out.withColumn("_i", F.explode(F.sequence(F.col("_chunk") * CHUNK + 1, F.least("_n", (F.col("_chunk") + 1) * CHUNK))))
    own = [F.substring(F.col(c), F.lit(1), heads[c]) if c in heads else F.col(c) for c in columns]
    return out.select(F.when(F.col("_ids") > 0, F.col("_key")).cast(docs.schema[key].dataType).alias(key), *columns, *[F.when(F.col("_i") < F.col("_n"), o).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for o, c in zip(own, columns)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, and of the text with its last quarter replaced.

    The edited text has the last floor(n/4) code points replaced by the first as
    many (or all) of the next document by doc_id.  Null text counts as empty; two
    texts without words have equal, empty fingerprints and likeness 1.  Rows of
    one doc_id follow each other by their first 32 code points, then by a hash of the
    text; a lone document is its own next.  Rows without an id come first.  An empty table gives no rows; extra columns are ignored, also those named as
    results.  Equal texts have equal fingerprints, and ties of hashes go by position.
    Very long texts are arrays of their words, of any number that a row can hold.
    """
    own = with_signature(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "text", "sig")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    pairs = with_next(own, "doc_id", ["text", "sig"], heads={"text": quarter})
    edited = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.col("next_text")).alias("edited"), "sig", "next_sig")
    out = with_signature(edited, "edited", "edited_sig")
    return out.select(
        "doc_id", "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: fingerprints of every document and its edited text."""
    return fingerprints(table(spark, sf_dir, "documents")).drop("edited")
