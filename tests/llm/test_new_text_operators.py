"""Small cases and brute-force versions for SuperMinHash groups, word runs and spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomplan.llm import spelling, super_minhash, word_runs
from loomplan.llm.common import U64, scramble

CLASHING = "doc_id long, text string, rep long, key long, word string, component_id string, runs string, n string"


def table_of(spark, rows):
    """doc_id and text with extra columns named as inner ones are."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", "v") for i, t in rows], CLASHING)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- op 11 ----------------------------------------------------------------


def grouped(rows, threshold=80, width=2):
    """By comparing all pairs: (n_shingles, least id reached) of each row."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[top(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min(ids[top(i)], default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("threshold,bands", [(80, 32), (60, 200)])
def test_near_groups_against_all_pairs(spark, monkeypatch, threshold, bands):
    monkeypatch.setattr(super_minhash, "BLOCK", 8)
    monkeypatch.setattr(super_minhash, "BUNDLE", 64)
    rng = random.Random(5)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300]))]
        rows += [(0, edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.1]))) for _ in range(30)]
    chain = [f"c{i}" for i in range(120)]
    rows += [(0, " ".join(chain[i : i + 60])) for i in range(0, 60, 3)]
    rows += [(0, t) for t in ["one", "ONE", "one ", "two", "a b", "A\tB", "a b a b", "", None, " \n", "é é", "É é"]]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(None, rows[0][1]), (None, "alone and without an id"), (3, rows[3][1])]
    got = super_minhash.near_groups(table_of(spark, rows), threshold=threshold, bands=bands).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(i, n, c, (i == c)) for i, n, c, _ in grouped(rows, threshold)]


def test_near_groups_of_one_large_group(spark, monkeypatch):
    """A hub that all others are near to, while most pairs of the others aren't."""
    monkeypatch.setattr(super_minhash, "BLOCK", 32)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, 0.055)) for i in range(250)] + [(250, " ".join(base))] + [(300 + i, edited(rng, base, 0.3)) for i in range(60)]
    got = super_minhash.near_groups(table_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == grouped(rows)


def test_near_groups_of_nothing(spark):
    assert super_minhash.near_groups(table_of(spark, [])).collect() == []
    got = super_minhash.near_groups(table_of(spark, [(7, None), (8, ""), (None, " ")])).collect()
    assert sorted(map(tuple, got), key=repr) == [(7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True)]


def one_by_one(codes, registers):
    """The published loop: each element deals its values by a shuffle, and stops at the largest register."""
    h = [2**64 - 1] * registers
    for x in codes.tolist():
        order = list(range(registers))
        for j in range(registers):
            z = int(scramble(np.array([x], dtype=U64), 1_000 + j)[0])
            k = j + (((z & 0xFFFFFFFF) * (registers - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            h[order[j]] = min(h[order[j]], (j << 32) | (z >> 32))
    return h


def test_superminhash_equals_the_plain_loop():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 40, 1, 400])
    codes = rng.integers(0, 2**63, sizes.sum()).astype(U64)
    got = super_minhash.superminhash(codes, sizes, 20)
    ends = np.cumsum(sizes)
    for row, n, e in zip(got.tolist(), sizes.tolist(), ends.tolist()):
        assert row == one_by_one(codes[e - n : e], 20)


def test_superminhash_estimates_with_less_variance():
    rng, errors, registers = np.random.default_rng(4), [], 160
    for _ in range(300):
        x = rng.integers(0, 2**63, 60).astype(U64)
        a, b = x[:50], np.concatenate((x[:40], x[50:]))
        s = super_minhash.superminhash(np.concatenate((a, b)), np.array([50, 50]), registers)
        errors.append((s[0] == s[1]).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / registers
    assert abs(np.mean(errors)) < 4 * (independent / 300) ** 0.5
    assert np.var(errors) < 0.75 * independent


# --- op 12 ----------------------------------------------------------------


def all_runs(w, least):
    """By every period: stretches where words a period apart are equal, of smallest period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                s = w[i : i + length]
                if not any(all(s[k] == s[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_against_every_period(least):
    rng = random.Random(least)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(1, 70))]
        if rng.random() < 0.5:
            w = (w[: rng.randrange(1, len(w) + 1)] * 9)[:90]
        assert word_runs.runs_of(np.array(w), least) == all_runs(w, least)


def test_runs_of_very_long_texts():
    assert word_runs.runs_of(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    x = np.tile(np.random.default_rng(1).integers(0, 900, 7_000), 6)
    assert word_runs.runs_of(np.concatenate((x, [-1], x[:5_000]))) == [(0, 42_000, 7_000)]


def contract(doc_id, text):
    """One row of the query by its words."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept)


def test_word_runs_query_by_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcé") for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(200 + i, " \n".join(f"w{rng.randrange(500)}" for _ in range(120))) for i in range(60)]
    rows += [(300, "no no " * 9), (301, "No no " * 9), (302, "x " * 5_000), (303, None), (304, ""), (305, "\t \n"), (300, "no no " * 9), (None, "a b " * 8)]
    got = word_runs.digests(word_runs.word_runs(table_of(spark, rows), plant=True)).collect()
    assert Counter(map(tuple, got)) == Counter(contract(i, t) for i, t in rows if t != "x " * 5_000) + Counter(
        [(302, 1, 0, 5_000, 1, 5_000_000, hashlib.sha256(b"0,5000,1\n").hexdigest(), hashlib.sha256(b"x").hexdigest())]
    )


def test_word_runs_give_texts(spark):
    got = word_runs.word_runs(table_of(spark, [(10, "go  on and on and on and on and on and on and on stop")])).first()
    assert [tuple(r) for r in got.runs] == [(1, 13, 2)] and tuple(got.longest) == (1, 13, 2)
    assert got.collapsed == "go on and stop"
    assert word_runs.word_runs(table_of(spark, [])).collect() == []


# --- op 13 ----------------------------------------------------------------


def variants(rows, factor=5):
    """By comparing all words."""
    total = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 199 == 0 and doc_id is not None:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    total = {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in total.items():
        others = [o for o in total if near(w, o)]
        best = min(others, key=lambda o: (-total[o], o), default=None)
        form = best if best and total[best] >= factor * n else None
        out[w] = [w, form, None, n, len(others), total[form] if form else None]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w][2] = root
    return {tuple(r) for r in out.values()}


def test_spelling_variants_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["planning", "garment", "seasons", "éclairée", "aaaaaaaa", "listen", "silent", "orders"]
    weights = {w: rng.choice([5, 30, 160, 900]) for w in base}
    for w in list(base):
        for _ in range(12):
            x, at = weights and w, rng.randrange(len(w))
            for _ in range(rng.choice([1, 1, 2])):
                x = rng.choice([x[:at] + x[at + 1 :], x[:at] + rng.choice("aeéz") + x[at + 1 :], x[:at] + rng.choice("aeéz") + x[at:]])
            weights.setdefault(x, rng.choice([4, 5, 6, 30, 150]))
    rows = [(rng.randrange(40), rng.choice([w, w.capitalize() if w.isascii() else w])) for w, n in weights.items() for _ in range(n)]
    texts = defaultdict(list)
    for i, w in rows:
        texts[i].append(w)
    docs = [(i, rng.choice([" ", "-", "1", "\n"]).join(ws)) for i, ws in texts.items()]
    docs += [(50, None), (51, ""), (52, "12 ... €"), (None, "orders orders"), (53, "Ä ÀÀÀ × ÷ straße" * 7), (53, "Ä ÀÀÀ × ÷ straße" * 7)]
    got = spelling.spelling_forms(spelling.corpus_words(table_of(spark, docs), plant=True)).collect()
    assert {tuple(r) for r in got} == variants(docs) and len(got) == len(variants(docs))
    assert any(r.root != (r.form or r.word) for r in got)


def test_signatures_meet_for_every_near_pair():
    rng = random.Random(1)
    for _ in range(500):
        w = "".join(rng.choice("abcdeéz") for _ in range(rng.randrange(1, 14)))
        at = rng.randrange(len(w))
        for x in (w[:at] + w[at + 1 :], w[:at] + "q" + w[at + 1 :], w[:at] + "b" + w[at:]):
            for parts in (3, 6):
                a, b = spelling.signatures([w, x], parts)
                assert (a == b).any()


def test_spelling_edges(spark):
    words = spark.createDataFrame([("", 9), (None, 9), ("a", 50), ("b", 9), ("a" * 30_000, 7), ("a" * 30_001, 70)], "word string, n long")
    got = {r.word: tuple(r) for r in spelling.spelling_forms(words).collect()}
    assert got["b"] == ("b", "a", "a", 9, 1, 50) and got[""] == ("", None, "", 9, 0, None) and got[None] == (None, None, None, 9, 0, None)
    assert got["a" * 30_000][1] == "a" * 30_001
    assert spelling.spelling_forms(words.where("n > 100")).collect() == []
    assert spelling.corpus_words(table_of(spark, [])).collect() == []


def test_words_travel_once_a_task(spark, monkeypatch):
    docs = table_of(spark, [(i, "planning garment") for i in range(400)]).repartition(4)
    plan = spelling.corpus_words(docs)
    assert {tuple(r) for r in plan.collect()} == {("planning", 400), ("garment", 400)}
    monkeypatch.setattr(spelling, "HELD", 1)
    assert {tuple(r) for r in spelling.corpus_words(docs.withColumn("text", F.col("text"))).collect()} == {("planning", 400), ("garment", 400)}
