"""Tokens, packing, packed output and edit-aware counts."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomplan.llm import bpe, edit_counts, packing, token_output

ALPHABET = ["a", "bc", "'s", " ", "\n", "  ", "9", "!", "é", "'", "\t", "ll", "\r", "the", "and", "’", "“", "—", "ß", "\x85", "中", "ǅ", "́", "²", "<|endoftext|>", "\xa0", "_", "\x00", " the", "."]


def random_texts(seed, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(most))) for _ in range(n)]


def test_ids_are_those_of_tokenizers(spark, sf):
    e = bpe.encoder(bpe.vocabulary())
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text in random_texts(1, 4000) + real:
        ids = e.model.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == np.array(ids, dtype="<u4").tobytes() and e.count(text) == len(ids)


def test_piece_spans():
    assert packing.piece_spans(5, 4) == [(0, 1), (1, 4)] and packing.piece_spans(8, 4) == [(0, 4), (4, 4)] and packing.piece_spans(4, 4) == [(0, 4)]


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(1, 50, rng.integers(1, 80))
        bins, offsets = packing.best_fit_decreasing(lengths, 50)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(50 - lengths[i])
        assert bins.max() + 1 == len(room)
        assert sorted(50 - np.bincount(bins, weights=lengths)) == sorted(room)
        assert packing.lower_bound(lengths, 50) <= len(room)
        for b in range(bins.max() + 1):
            own = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][own])[:-1] == offsets[bins == b][own][1:]).all()


def test_lower_bound_holds():
    assert packing.lower_bound(np.array([], dtype=int)) == 0
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.array([50, 50, 25, 25, 25, 25]), 100) == 2


def check_packed(rows, texts, capacity):
    e = bpe.encoder(bpe.vocabulary())
    ids = {i: e.encode(t or "") + b"\x00" * 4 for i, t in texts}
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, pieces in by_doc.items():
        assert [(s, n) for _, s, n in sorted(pieces)] == packing.piece_spans(len(ids[i]) // 4, capacity)
    assert set(by_doc) == set(ids)
    return len(by_seq), sum(len(v) // 4 for v in ids.values())


def test_packing_with_exchange_rounds(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["the", "and", "of", "x"], k=rng.choice([3, 20, 33, 40, 150])))) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    rows = packing.best_fit_packing(docs, capacity=64, group=50).collect()
    n, tokens = check_packed(rows, texts, 64)
    assert n >= -(-tokens // 64)
    once = packing.best_fit_packing(docs, capacity=64, group=50, rounds=1).select("sequence_id").distinct().count()
    assert n <= once
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def test_packing_documents(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, tokens = check_packed(packing.op2_best_fit_packing(spark, sf).collect(), texts, 2048)
    assert n <= 1.05 * -(-tokens // 2048) + 1


def test_token_output_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    packed = token_output.packed_sequences(docs, group=60)
    token_output.write_packed(packed, str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    e = bpe.encoder(bpe.vocabulary())
    parts = defaultdict(dict)
    for r in token_output.unpack(packed).collect():
        parts[r["doc_id"]][r["piece"]] = bytes(r["ids"])
    for r in docs.collect():
        own = parts[r["doc_id"]]
        assert b"".join(own[k] for k in sorted(own)) == e.encode(r["text"] or "") + b"\x00" * 4
    for r in packed.collect():
        at = np.frombuffer(r["position_ids"], dtype="<u4")
        assert len(r["ids"]) == 4 * 2048 and r["cu_seqlens"][-1] == r["n_tokens"]
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert at[a:b].tolist() == list(range(b - a))
    assert token_output.packed_sequences(docs.limit(0)).count() == 0


def test_edit_counts_against_encoding_anew(spark):
    e = bpe.encoder(bpe.vocabulary())
    rng = random.Random(4)
    for t in random_texts(5, 300, 160):
        tree = edit_counts.SegmentTree(t, e.count, rng.choice([4, 16, 64]))
        for _ in range(5):
            a, r = rng.randrange(len(t) + 3), rng.choice(random_texts(rng.random(), 3))
            b = a + rng.randrange(30)
            tree.edit(a, b, r)
            t = t[:a] + r + t[max(a, b) :]
            assert tree.text == t and tree.tokens[1] == e.count(t) and tree.chars[1] == len(t)


def test_edit_counts_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    e = bpe.encoder(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    edits = {r["doc_id"]: r["edits"] for r in edit_counts.own_edits(docs).collect()}
    for r in edit_counts.op3_edit_counts(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == e.count(t)
        for x in edits[r["doc_id"]]:
            t = t[: x["start"]] + x["text"] + t[max(x["start"], x["stop"]) :]
        assert (r["edited_tokens"], r["edited_chars"]) == (e.count(t), len(t))
    blank = spark.createDataFrame([(1, None, None), (2, "", [(None, None, None)]), (None, "a b", [(0, 1, "c")])], f"doc_id long, text string, edits {edit_counts.EDITS}")
    assert sorted((r["edited_chars"], r["edited_tokens"]) for r in edit_counts.edit_aware_counts(blank).collect()) == [(0, 0), (0, 0), (3, 2)]
    assert edit_counts.edit_aware_counts(blank.limit(0)).count() == 0


def test_kept_state_spares_the_tokenizer(spark, sf):
    """A second call reads the leaves that its edits touch, not the text."""
    e = bpe.encoder(bpe.vocabulary())
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["word", "and", "other", "things,"]) for _ in range(4000))) for i in range(3)] + [(7, "ab1" * 20_000), (8, "漢字、" * 9000), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    state = edit_counts.count_tokens(docs)
    now = {i: t or "" for i, t in texts}
    for turn in range(2):
        edited = edit_counts.apply_edits(state.withColumn("edits", F.expr(f"cast(array(struct(500 as start, 503 as stop, 'new{turn} ' as text)) as {edit_counts.EDITS})")))
        rows = edited.collect()
        for r in rows:
            t = now[r["doc_id"]]
            t = now[r["doc_id"]] = t[:500] + f"new{turn} " + t[503:]
            assert (r["text"], r["n_chars"], r["n_tokens"]) == (t, len(t), e.count(t))
            assert sum(r["state"]["chars"]) == len(t) and sum(r["state"]["tokens"]) == e.count(t)
            assert r["encoded_chars"] <= 2000
        state = spark.createDataFrame([(r["doc_id"], r["text"], r["state"]) for r in rows], f"doc_id long, text string, state {edit_counts.STATE}")


def test_packing_and_output_with_one_id_and_long_texts(spark):
    """Repeated and null ids are dealt like others; a long text's whole pieces aren't in a group."""
    rows = [(5, "the and of " * 4)] * 40 + [(None, "x y z")] * 20 + [(2**53 + 1, "a " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    packed = packing.best_fit_packing(docs, group=10).collect()
    assert len(packed) == 60 + 15 and {r["doc_id"] for r in packed} == {5, None, 2**53 + 1}
    out = token_output.packed_sequences(docs, group=10)
    assert sorted(((r["doc_id"] or 0, r["piece"]) for r in token_output.unpack(out).collect())) == sorted([(5, 0)] * 40 + [(0, 0)] * 20 + [(2**53 + 1, k) for k in range(15)])
    assert len({r["sequence_id"] for r in out.collect()}) == out.count()
