"""Self-join of documents on the Jaccard similarity of word shingles, by chosen paths.

Each set is embedded as ``COORDS`` MinHash values; a (coordinate, value) is a token
that two sets share with a probability of their similarity.  A run splits the sets by
the token at a sampled coordinate, and splits what is still large by further
ones; a bucket of at most ``SMALL`` sets, or one still larger after ``DEPTH`` splits (fewer at
lower thresholds, ``depth_of``), is compared by brute force, large ones in pairs of blocks.
Runs come in rounds of ``RUNS`` and are repeated until the recall reaches the target.
Each round estimates it on the data: from how many pairs that earlier rounds didn't hold
one run of the round has, and how many two have, Chao's estimator gives how many no run
has.  No two runs of the first round share a coordinate, so they are independent: at
the threshold of 0.8 a pair stays together for d splits with 0.8**d, and sixteen runs
miss 0.02 % of such pairs at the four splits that the largest buckets take, 1e-5 at
three and less at fewer.  Later rounds take the coordinates in another order.

Equal sets are joined first, as one class of copies that has a number of its own; ids
only name the classes at the end, so neither repeated nor null ids make or lose a link.
In buckets, signatures choose the members that have a likely partner; only their whole
shingle sets are fetched, and each pair is verified exactly in its first shared bucket,
so that links are counted once without a list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import U64, cut, lowered, portions, scramble, shingle_codes, table, word_codes

WIDTH, THRESHOLD = 5, 0.8
#: Runs of a round, most splits of a run, MinHash values of a set.
RUNS, DEPTH, COORDS = 16, 4, 64
#: A run keeps a pair at the threshold together with this probability at least, if it has one split or more.
TOGETHER = 0.4
#: The estimated share of all links that ends the rounds.
RECALL = 0.9995
SMALL = 64
#: Sets in a block of a large bucket; blocks meet two at a time.
BLOCK = 256
#: Bucket members in a bundle on average: what one call of a task looks at.
BUNDLE = 4_096
XORS, FACTORS = scramble(np.arange(COORDS), 21), scramble(np.arange(COORDS), 22) | U64(1)


def depth_of(threshold: float) -> int:
    """Splits of a run: as many as keep a pair at the threshold together with ``TOGETHER``, one to ``DEPTH``.

    Four at 0.8, two at 0.65, one at 0.5: fewer splits of larger buckets find what is less alike.
    """
    return next((d for d in range(DEPTH, 1, -1) if threshold**d >= TOGETHER), 1)


def likely_share(threshold: float) -> float:
    """Pairs whose signatures agree less are not verified: five standard deviations under the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / COORDS) ** 0.5


def splits(run: int, depth: int = DEPTH) -> list[int]:
    """The coordinates of a run in the order of its splits; each is in one of COORDS / depth runs."""
    turn, at = divmod(run, COORDS // depth)
    return np.argsort(scramble(np.arange(COORDS), 100 + turn))[at * depth : (at + 1) * depth].tolist()


def sets_of(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle codes of each text."""
    for a, b in portions(texts):
        codes, counts = word_codes(texts[a:b])
        shingles, sizes = shingle_codes(codes, counts, width)
        at = 0
        for n in sizes.tolist():
            yield np.unique(shingles[at : at + n])
            at += n


def signature(codes: np.ndarray) -> np.ndarray:
    """The upper halves of the least hash values, one for each coordinate; zeros for an empty set."""
    if not len(codes):
        return np.zeros(COORDS, dtype=np.uint32)
    low = np.full(COORDS, 2**64 - 1, dtype=U64)
    for at in range(0, len(codes), 4096):
        np.minimum(low, ((codes[None, at : at + 4096] ^ XORS[:, None]) * FACTORS[:, None]).min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, a hash of the text: with the id it finds a row's text again."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def signatures(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, set_key (128 bits of the shingle set), n_shingles and the MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for s in sets_of([lowered(t.as_py()) for t in batch.column(1)], width):
                keys.append(set_key(s))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "set_key", "n_shingles", "sig"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, set_key binary, n_shingles int, sig binary")


def set_key(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def leaves(reps: DataFrame, runs: range, depth: int = DEPTH) -> DataFrame:
    """(rep, run, leaf, n): the bucket of at least two sets in which each set ends, for each run."""
    paths = []
    for r in runs:
        steps, path = [], F.lit(r).cast("long")
        for c in splits(r, depth):
            path = F.xxhash64(path, F.substring("sig", c * 4 + 1, 4))
            steps.append(path)
        paths.append(F.struct(F.lit(r).alias("run"), F.array(*steps).alias("path")))
    rows = reps.select("rep", F.explode(F.array(*paths)).alias("x")).select("rep", "x.run", "x.path")
    out = None
    for level in range(depth):
        step = rows.withColumn("leaf", F.get("path", F.lit(level)))
        # Written, so that the join meets plain rows on both sides and a large bucket can be split.
        counts = cut(step.groupBy("run", "leaf").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{level}")
        step = cut(step.join(counts, ["run", "leaf"]), f"split-{level}")
        ended = step if level == depth - 1 else step.where(F.col("n") <= SMALL)
        ended = ended.select("rep", "run", "leaf", "n")
        out = ended if out is None else out.unionByName(ended)
        rows = step.where(F.col("n") > SMALL).select("rep", "run", "path")
        if level < depth - 1 and rows.isEmpty():
            break
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Adds (left, right): a small bucket is one group; of a large one each pair of blocks is."""
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.when(F.col("n") <= SMALL, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), count)).cast("int")
    others = F.when(F.col("n") <= SMALL, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), count - 1))
    both = members.withColumn("block", own).withColumn("other", F.explode(others))
    return both.select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("other")


def _shared_runs(vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which runs have the pair in one bucket, as rows of truth values."""
    a, b = vectors[i], vectors[j]
    return (a == b) & (a != 0)


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of one group of pairs next to each other, and the number of each row's group."""
    pdf = pdf.sort_values(["run", "leaf", "left", "right", "rep"], kind="stable", ignore_index=True)
    key = pdf[["run", "leaf", "left", "right"]].to_numpy()
    return pdf, np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))


def _pairs(pdf: pd.DataFrame, group: np.ndarray, most: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of the pairs that the groups are to look at: across two blocks, or within one."""
    block, across = pdf["block"].to_numpy(), (pdf["left"] != pdf["right"]).to_numpy()
    n, ii, jj, held = len(group), [], [], 0
    for d in range(1, int(np.bincount(group).max())):
        i = np.flatnonzero(group[:-d] == group[d:])
        i = i[~across[i] | (block[i] != block[i + d])]
        ii.append(i)
        jj.append(i + d)
        held += len(i)
        if held > most:
            yield np.concatenate(ii), np.concatenate(jj)
            ii, jj, held = [], [], 0
    if held and n:
        yield np.concatenate(ii), np.concatenate(jj)


def _likely(first_run: int, threshold: float):
    """Members with a partner that the signatures call likely and no earlier run holds.

    For the recall, one row of each call counts the new pairs that the signatures put at
    the threshold or more: all, those in one run of this round, and those in two.
    """

    least = likely_share(threshold) * COORDS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, group = _sorted(pdf)
        vectors, runs = np.stack(pdf["vector"].to_numpy()), pdf["run"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), COORDS)
        hit = np.zeros(len(pdf), dtype=bool)
        seen = np.zeros(3, dtype=np.int64)
        for i, j in _pairs(pdf, group):
            alike = (sig[i] == sig[j]).sum(axis=1)
            near = alike >= least
            i, j, alike = i[near], j[near], alike[near]
            shared = _shared_runs(vectors, i, j)
            new = shared.argmax(axis=1) == runs[i]
            hit[i[new]] = hit[j[new]] = True
            times = shared[new & (alike >= threshold * COORDS), first_run:].sum(axis=1)
            seen += len(times), (times == 1).sum(), (times == 2).sum()
        out = pdf.loc[hit, ["rep", "run", "leaf", "n", "copies", "block", "left", "right", "vector"]]
        counts = np.zeros((len(out), 3), dtype=np.int64)
        counts[:1] = seen
        return out.assign(pairs=counts[:, 0], once=counts[:, 1], twice=counts[:, 2])

    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many codes each two sets share, by products of an incidence matrix, in portions of codes."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float64)
    codes, where, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    place = np.cumsum(seen > 1) - 1
    kept = seen[where] > 1
    rows, columns = rows[kept], place[where[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, total, 4096):
        a, b = np.searchsorted(columns, [at, at + 4096])
        x = np.zeros((n, 4096), dtype=np.float32)
        x[rows[a:b], columns[a:b] - at] = 1
        out += x @ x.T
    return out


def _verified(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, group = _sorted(pdf)
        rep, copies, runs = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["run"].to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in pdf["codes"]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        vectors = np.stack(pdf["vector"].to_numpy())
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        links = np.zeros(len(rep), dtype=np.int64)
        root = rep.copy()
        for i, j in _pairs(pdf, group):
            shared = np.zeros(len(i))
            of = group[i]
            order = np.argsort(of, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                if len(at) == 1:
                    a, b = sets[i[at[0]]], sets[j[at[0]]]
                    shared[at] = len(a) + len(b) - len(np.union1d(a, b))
                else:
                    first = starts[of[at[0]]]
                    last = max(int(j[at].max()), int(i[at].max())) + 1
                    shared[at] = _shared_counts(sets[first:last])[i[at] - first, j[at] - first]
            near = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
            i, j = i[near], j[near]
            new = _shared_runs(vectors, i, j).argmax(axis=1) == runs[i]
            i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # The least rep that links reach within a group.
            while len(i):
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if (before == root).all():
                    break
        return pd.DataFrame({"rep": rep, "links": links, "root": root})[links > 0]

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of ``edges`` (a, b).

    Large-star and small-star steps by turns, each an aggregate and a join, until
    nothing changes.  Nodes without edges have no row.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # The edges are distinct; unlike a sum of hashes, their parity can't overflow.
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least neighbours are written first: the join then meets plain rows on both
        # sides, and the rows of a node with very many neighbours can be split.
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # Small star: now every edge points down, so the neighbours of a are all under it.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.where("a <> b").distinct(), "edges")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def unseen(once: int, twice: int, runs: int = RUNS) -> float:
    """Chao's estimate of the pairs that no run has, from those in one run and in two."""
    return (runs - 1) / runs * once * (once - 1) / (2 * (twice + 1))


def jaccard_classes(docs: DataFrame, *, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, text_key, is_first for every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``width``-word shingles (lower-cased;
    a shorter text is one shingle) have a Jaccard similarity of ``threshold`` or
    more.  ``class_id``: the least doc_id of those that links connect; ``n_links``:
    how many other rows a row is linked to, copies included; ``n_copies``: rows
    with an equal set, the row itself included.  ``text_key``: a hash of the text;
    ``is_first``: whether the row's (doc_id, text_key) is the least of its class, a
    null id after all others, so one row of each class and its exact repeats have it.

    Null, empty and blank texts have the empty set and are copies of each other.
    Repeated rows count as rows, and rows of one id with different texts are rows by
    themselves.  A null doc_id is a row like others; it names a class, as null, only
    if no row of the class has an id.  Very long texts have long sets and are treated
    alike.  An empty table gives no rows; extra columns are ignored, also those
    named as the results.
    """
    texts = docs.select("doc_id", "text")
    signed = cut(signatures(texts, width=width), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_key")).alias("first")
    classes = signed.groupBy("set_key").agg(first, F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    # Numbered as they are written: from here on a set goes by its number.
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    alive = classes.where("n_shingles > 0")

    members = found = None
    pairs, start = 0, 0
    while True:
        runs = range(start, start + RUNS)
        new = cut(leaves(alive.select("rep", "sig"), runs, depth_of(threshold)), "leaves")
        members = new if members is None else members.unionByName(new)
        links, seen = _links(texts, members, new, alive, runs, threshold, width)
        found = links if found is None else found.unionByName(links)
        pairs += seen["pairs"]
        start += RUNS
        if pairs >= recall * (pairs + unseen(seen["once"], seen["twice"])):
            break

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("set_key", "rep", "first", "copies").join(linked, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = cut(named.select("set_key", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), "root"), "named")
    # Written, as a class may have very many sets and its rows can then be split.
    least = cut(named.where("root is not null").groupBy("root").agg(F.min("first").alias("least")), "least-of-class")
    named = named.join(least, "root", "left").withColumn("least", F.coalesce("least", "first"))
    of_set = cut(named.select("set_key", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "sets")
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    out = signed.select("doc_id", "text_key", "set_key").join(of_set, "set_key")
    return out.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links", "n_copies", "text_key", is_first.alias("is_first"))


def _links(texts: DataFrame, members: DataFrame, new: DataFrame, alive: DataFrame, runs: range, threshold: float, width: int) -> tuple[DataFrame, Row]:
    """Links (rep, links, root) of one round that no earlier round holds, and what it has seen for the recall."""
    vector = F.map_from_entries(F.collect_list(F.struct("run", "leaf")))
    every = [F.coalesce(F.try_element_at("by_run", F.lit(r)), F.lit(0).cast("long")) for r in range(runs.stop)]
    vectors = members.groupBy("rep").agg(vector.alias("by_run")).select("rep", F.array(*every).alias("vector"))
    known = alive.select("rep", "copies", "sig").join(vectors, "rep")
    # Many small groups of pairs share a task's call; a group lies whole in one bundle.
    bundles = max(1, -(-new.count() // BUNDLE))
    group = F.pmod(F.xxhash64("run", "leaf", "left", "right"), F.lit(bundles)).alias("bundle")
    narrow = "rep long, run int, leaf long, n long, copies long, block int, left int, right int, vector array<long>, pairs long, once long, twice long"
    likely = cut(_blocks(new.join(known, "rep")).groupBy(group).applyInPandas(_likely(runs.start, threshold), narrow), "likely")
    seen = likely.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "once", "twice")]).first()

    # One text of each wanted set; the set made of it must be the wanted one.
    wanted = likely.select("rep").distinct().join(alive.select("rep", "set_key", "first"), "rep").select("rep", "set_key", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    own = keyed(texts).join(cut(wanted, "wanted").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    sets = own.select("rep", "text", "set_key").mapInArrow(_codes(width), "rep long, codes binary")
    likely = likely.drop("pairs", "once", "twice")
    found = likely.join(sets.dropDuplicates(["rep"]), "rep").groupBy(group).applyInPandas(_verified(threshold), "rep long, links long, root long")
    return cut(found, "links"), seen


def _codes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = list(sets_of([lowered(t.as_py()) for t in part.column(1)], width))
                right = [set_key(s) == k.as_py() for s, k in zip(sets, part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(right, pa.bool_())), pa.array([s.tobytes() for s, ok in zip(sets, right) if ok], pa.binary())], names=["rep", "codes"])

    return run


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: near-duplicate classes and link counts of all documents."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b, k = x.n AND k = y.n AS same FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links, 1 + coalesce(l.same, 0) AS n_copies
FROM documents d LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n, count(*) FILTER (WHERE same) AS same FROM links GROUP BY a) l ON l.a = d.doc_id
"""
