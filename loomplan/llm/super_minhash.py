"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

A signature has ``BANDS * ROWS`` registers.  Each shingle deals itself to all registers in
a random order of its own, with the values 0 + r, 1 + r', 2 + r'' and so on (r random in
[0, 1)); a register keeps its least value.  The dealt places of one shingle never repeat,
so registers are negatively correlated and agreement varies less than with independent
hash functions.  A step j can't lower anything once every register is under j, so a
document stops there: long documents after one step, those of 500 shingles after about
three.  The steps of all documents of a portion are taken together, as arrays.

Two sets that agree in all registers of a band share a bucket; at the threshold of 0.8 a
pair misses all 32 bands of five registers with a probability of 3e-6, while documents
that share a tenth of their shingles meet in 0.03 % of cases.

Within a bucket not every pair is compared.  Members are first compared with one leader
that differs from bucket to bucket, and verified links are united; most of a large group
of copies is then one component, whose inner pairs need no look.  What is left, pairs
of *different* components in one bucket, is looked at in blocks of bounded size: those
outside a bucket's largest component against all its members.  So no link between
different components is lost, and no list of a group's pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import U64, cut, lowered, portions, scramble, shingle_codes, table, word_codes
from loomplan.llm.jaccard_join import components, keyed, set_key

WIDTH = 2
#: Per cent of the union that linked documents share at least.
THRESHOLD = 80
BANDS, ROWS = 32, 5
#: Members in a block of a bucket that holds several components; blocks meet two at a time.
BLOCK = 256
#: Rows that one call looks at, about.
BUNDLE = 4_096
HALF = U64(32)


def superminhash(codes: np.ndarray, sizes: np.ndarray, registers: int) -> np.ndarray:
    """One row of ``registers`` values for each set; ``codes``: distinct elements, set by set.

    The upper half of a value is its step, the lower half random, so order and equality
    are those of step + r.  An empty set keeps the largest value everywhere.
    """
    out = np.full(len(sizes) * registers, 2**64 - 1, dtype=U64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = None  # of each element still at work: the places it has yet to deal, from place j on
    for j in range(registers):
        if not len(codes):
            break
        z = scramble(codes, 1_000 + j)
        pick = (U64(j) + (((z & U64(0xFFFFFFFF)) * U64(registers - j)) >> HALF)).astype(np.int64)
        if order is None:
            place = pick
        else:
            row = np.arange(len(codes))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
        np.minimum.at(out, owner * registers + place, (U64(j) << HALF) | (z >> HALF))
        at_work = np.unique(owner)
        late = at_work[out.reshape(-1, registers)[at_work].max(axis=1) >= U64(j + 1) << HALF]
        stays = np.isin(owner, late)
        if order is None:
            order = np.tile(np.arange(registers, dtype=np.uint16), (int(stays.sum()), 1))
            order[np.arange(len(order)), place[stays]] = 0
        else:
            order = order[stays]
        codes, owner = codes[stays], owner[stays]
    return out.reshape(-1, registers)


def distinct_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle codes of each text, end to end, and how many each has."""
    codes, counts = word_codes(texts)
    shingles, sizes = shingle_codes(codes, counts, width)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    first = np.ones(len(shingles), dtype=bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[first], np.bincount(owner[first], minlength=len(texts))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = scramble(signatures, 7).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(scramble(np.arange(bands), 8), (len(signatures), bands))
    for r in range(rows):
        key = scramble(key ^ parts[:, :, r], 9 + r)
    return key


def sketches(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, set_key (128 bits of the set), n_shingles, the band keys and a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [lowered(t.as_py()) for t in batch.column(1)]
            # Smaller portions than elsewhere: each shingle at work holds its order of all registers.
            for a, b in portions(texts, 300_000):
                codes, sizes = distinct_shingles(texts[a:b], width)
                signed = superminhash(codes, sizes, bands * rows)
                ends = np.cumsum(sizes)
                sets = [set_key(codes[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                keys = band_keys(signed, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                byte = (scramble(signed, 7) & U64(255)).astype(np.uint8)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array([x.tobytes() for x in byte], pa.binary())],
                    names=["doc_id", "text_key", "set_key", "n_shingles", "keys", "sig"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, set_key binary, n_shingles long, keys array<long>, sig binary")


def _sets(width: int):
    """Shingle codes of the texts whose set is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [lowered(t.as_py()) for t in batch.column(1)]
            for a, b in portions(texts):
                codes, sizes = distinct_shingles(texts[a:b], width)
                ends = np.cumsum(sizes).tolist()
                sets = [codes[e - n : e] for e, n in zip(ends, sizes.tolist())]
                right = [set_key(s) == k.as_py() for s, k in zip(sets, batch.column(2).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).filter(pa.array(right, pa.bool_())), pa.array([s.view(np.int64) for s, ok in zip(sets, right) if ok], pa.list_(pa.int64()))], names=["rep", "codes"]
                )

    return run


def _meets(shared, a, b, threshold: int):
    """Whether ``shared`` of two sets of ``a`` and ``b`` elements makes a link; columns or arrays."""
    return shared * 100 >= (a + b - shared) * threshold


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows outside the largest component, members) of each group of a bundle, as row numbers."""
    for at in pdf.groupby(["key", "o", "m"], sort=False).indices.values():
        outside = pdf["outside"].to_numpy()[at]
        yield at[outside], at[~outside]


def _likely(threshold: int, registers: int):
    """Rows with a partner of another component that sizes and signatures don't rule out.

    Signatures rule out what is four and a half standard deviations under the threshold.
    """
    t = threshold / 100
    least = (t - 4.5 * (t * (1 - t) / registers) ** 0.5) * registers

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, n = pdf["label"].to_numpy(), pdf["n_shingles"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), registers)
        hit = np.zeros(len(pdf), dtype=bool)
        for outside, members in _groups(pdf):
            for i in outside.tolist():
                other = members[label[members] != label[i]]
                other = other[_meets(np.minimum(n[other], n[i]), n[other], n[i], threshold)]
                other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
                hit[other] = True
                hit[i] |= len(other) > 0
        return pdf.loc[hit, ["key", "o", "m", "outside", "rep", "label"]]

    return run


def _verified(threshold: int):
    """(a, b): links between different components, found on whole sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, label, sets = pdf["rep"].to_numpy(), pdf["label"].to_numpy(), pdf["codes"].to_list()
        size = np.array([len(s) for s in sets], dtype=np.int64)
        a, b = [], []
        for outside, members in _groups(pdf):
            for i in outside.tolist():
                other = members[label[members] != label[i]]
                other = other[_meets(np.minimum(size[other], size[i]), size[other], size[i], threshold)]
                for j in other.tolist():
                    if _meets(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j], threshold):
                        a.append(rep[i])
                        b.append(rep[j])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)}).drop_duplicates()

    return run


def _rest(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, registers: int) -> DataFrame:
    """Links (a, b) between members of one bucket that have different labels still."""
    held = cut(members.where("n > 2").join(labels, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("label")), "labelled")
    # The largest component of each bucket that has several; a bucket's members are counted before they meet.
    by_label = held.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n")).where("most.c < n")
    mixed = cut(mixed.select("key", F.col("most.label").alias("base"), F.ceil((F.col("n") - F.col("most.c")) / BLOCK).cast("int").alias("os"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ms")), "mixed")
    rows = held.join(mixed, "key").withColumn("o", F.pmod(F.xxhash64("rep"), "os").cast("int")).withColumn("m", F.pmod(F.xxhash64("rep"), "ms").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.where("label <> base").withColumn("m", every("ms")).withColumn("outside", F.lit(True))
    inside = rows.withColumn("o", every("os")).withColumn("outside", F.lit(False))
    both = outside.unionByName(inside).select("key", "o", "m", "outside", "rep", "label")
    both = cut(both.join(classes.select("rep", "n_shingles", "sig"), "rep"), "blocks")
    bundles = max(1, -(-both.count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("key", "o", "m"), F.lit(bundles)).alias("bundle")
    narrow = "key long, o int, m int, outside boolean, rep long, label long"
    likely = cut(both.groupBy(bundle).applyInPandas(_likely(threshold, registers), narrow), "likely")
    found = likely.join(sets, "rep").groupBy(bundle).applyInPandas(_verified(threshold), "a long, b long")
    return cut(found, "late-links")


def near_groups(docs: DataFrame, *, threshold: int = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words end at ASCII white space, A-Z are lower-cased; a document's set is that of its
    runs of ``width`` words, or all its words as one where they are fewer.  Documents that
    share ``threshold`` per cent of their union or more are linked.  ``component_id``: the
    least doc_id that links reach, the document itself included; ``kept``: whether that
    is the document's own.  ``bands`` and ``rows`` are made for 80 per cent; under it, take
    more bands.

    Null, empty and blank texts have an empty set (``n_shingles`` 0) and are linked with
    nothing.  Rows that repeat an id are rows by themselves, each with the component of
    its own text.  A null doc_id is a row like others: it takes the least id of its
    component, and where there is none its component is null and it is kept.  Very long
    texts are read whole.  An empty table gives no rows; extra columns are ignored, also
    those named as the results.
    """
    texts = docs.select("doc_id", "text")
    signed = cut(sketches(texts, width=width, bands=bands, rows=rows), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_key")).alias("first")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(first, F.max("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    # Numbered as they are written: from here on a set goes by its number.
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    dealt = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    # rep xor key orders the members of each bucket in another way, so leaders differ.
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("low")).where("n > 1")
    buckets = cut(buckets.select("key", "n", F.col("low").bitwiseXOR(F.col("key")).alias("leader")), "buckets")
    members = cut(dealt.join(buckets, "key"), "members")

    wanted = members.select("rep").distinct().join(classes.select("rep", "set_key", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")), "rep")
    own = keyed(texts).join(cut(wanted, "wanted").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    sets = own.select("rep", "text", "set_key").mapInArrow(_sets(width), "rep long, codes array<long>")
    sets = cut(sets.dropDuplicates(["rep"]), "sets")

    star = cut(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    left, right = sets.select(F.col("rep").alias("a"), F.col("codes").alias("x")), sets.select(F.col("rep").alias("b"), F.col("codes").alias("y"))
    met = star.join(right, "b").join(left, "a")
    links = cut(met.where(_meets(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), threshold)).select("a", "b"), "links")
    labels = cut(components(links).select(F.col("node").alias("rep"), "root"), "labels")

    late = _rest(members, labels, classes, sets, threshold, bands * rows)
    if not late.isEmpty():
        known = labels.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        labels = cut(components(known.unionByName(late)).select(F.col("node").alias("rep"), "root"), "labels")

    named = cut(classes.select("set_key", "rep", F.col("first.doc_id").alias("own")).join(labels, "rep", "left").select("set_key", "own", "root"), "named")
    least = cut(named.where("root is not null").groupBy("root").agg(F.min("own").alias("least")), "least")
    ids = cut(named.join(least, "root", "left").select("set_key", F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id")), "ids")
    full = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(ids, "set_key")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: near-duplicate groups of all documents on two-word shingles, at 80 per cent."""
    return near_groups(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
