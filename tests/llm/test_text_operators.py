"""Small cases and brute-force versions for the operators on texts."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomplan.llm import class_lm, decontaminate, jaccard_join, license_scan, line_dedup, order_minhash, quality_gam
from loomplan.llm.common import lowered, shingle_codes, word_codes

SCHEMA = "doc_id long, text string, lang string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_word_and_shingle_codes_agree_with_words():
    texts = [lowered(t) for t in ["a b c d e f", "", "  A  B\tc\n", "é ü", "x" * 9000, "a b c d e", None]]
    codes, counts = word_codes(texts)
    assert counts.tolist() == [6, 0, 3, 2, 1, 5, 0]
    assert codes[:3].tolist() == codes[6:9].tolist()
    got, sizes = shingle_codes(codes, counts, 5)
    assert sizes.tolist() == [2, 0, 1, 1, 1, 1, 0] and got[0] == got[-1]


# --- op 8 -----------------------------------------------------------------


def deduped(rows, min_chars=40, min_docs=5):
    keys = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                keys[key(line)].add(i)
    gone = {k: max(v) for k, v in keys.items() if len(v) >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 1 << 18])
def test_line_dedup_is_exact(spark, bits):
    rng = random.Random(1)
    shared = [words(rng, 12) for _ in range(6)] + ["é" * 40, "x" * 39, "Y" * 40]
    rows = [(i, "\n".join(rng.choice([rng.choice(shared), f"  {rng.choice(shared).upper()}\t", words(rng, 3), ""]) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 200_000)]
    got = line_dedup.line_dedup(docs_of(spark, rows), bits=bits).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == deduped(rows)


def test_line_dedup_edges(spark):
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0
    line = "a line that is well over forty code points long"
    rows = [(1, line)] * 3 + [(i, line) for i in range(2, 6)] + [(None, line)]
    got = line_dedup.line_dedup(docs_of(spark, rows).withColumn("n_lines", F.lit("clash"))).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (None, 1)} and len(got) == 8


# --- op 4 -----------------------------------------------------------------


def test_contained_items_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randrange(1, 70))) for k in range(40)] + [(90, ""), (91, None)]
    rows = []
    for i in range(150):
        t = words(rng, rng.choice([3, 40, 400, 3000]))
        if i % 3 == 0:
            own = items[rng.randrange(40)][1].split()
            if i % 2 and len(own) > 30:
                own[len(own) // 2] = "changed"
            at = rng.randrange(len(t.split()))
            t = " ".join(t.split()[:at] + own + t.split()[at:])
        rows.append((i, t))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    expected = Counter()
    for i, t in rows:
        for k, item in items:
            q = shingles(item)
            n = len(next(iter(q))) if q else 0
            if q and len(q & shingles(t, n)) >= 0.8 * len(q) and len((t or "").split()) >= n:
                expected[i, k] += 1
    have = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 15):
        got = decontaminate.contained_items(docs_of(spark, rows), have, block=block).collect()
        found = Counter((r["doc_id"], r["item_id"]) for r in got)
        assert not found - expected
        assert sum((found & expected).values()) >= 0.98 * sum(expected.values())
    assert decontaminate.contained_items(docs_of(spark, []), have).count() == 0
    assert decontaminate.contained_items(docs_of(spark, rows), have.limit(0)).count() == 0


def test_short_items_are_found_in_long_documents(spark):
    """Items of 5 to 12 words, verbatim in documents of 3,000 words: none is missed."""
    rng = random.Random(12)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(5 + k % 8))) for k in range(240)]
    rows = []
    for k, item in items:
        t = words(rng, 3000).split()
        at = rng.randrange(len(t))
        rows.append((k, " ".join(t[:at] + [item] + t[at:])))
    have = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs_of(spark, rows), have).collect()}
    assert got == {(k, k) for k, _ in items}


# --- op 7 -----------------------------------------------------------------


def test_jaccard_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    rows = []
    for i in range(160):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = "edit%d" % rng.randrange(50)
        rows.append((i, " ".join(t) if i % 4 else words(rng, rng.choice([0, 2, 5, 60]))))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two")]
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = {i: {j for j in sets if j != i and near(sets[i], sets[j])} for i in sets}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        now = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
        if now == root:
            break
        root = now
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    missed = sum(len(links[i]) for i in sets) - sum(r["n_links"] for r in got.values())
    assert 0 <= missed <= 0.01 * sum(len(v) for v in links.values())
    assert sum(got[i]["class_id"] == root[i] for i in sets) >= 0.99 * len(sets)
    assert got[503]["n_copies"] == 2 and got[501]["class_id"] == root[501] == root[500] and got[500]["n_links"] == len(links[500])
    assert jaccard_join.jaccard_classes(docs_of(spark, [])).count() == 0


def test_jaccard_recall_in_a_large_bucket(spark):
    """600 different near copies, so that buckets are split as often as they can be: links by brute force."""
    rng = random.Random(13)
    base = words(rng, 300).split()
    rows = []
    for i in range(600):
        t = list(base)
        for x in rng.sample(range(0, 300, 6), 3):
            t[x] = f"edit{i}x{x}"
        rows.append((i, " ".join(t)))
    sets = [shingles(t) for _, t in rows]
    at = {s: n for n, s in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((600, len(at)), dtype=np.float32)
    for i, own in enumerate(sets):
        x[i, [at[s] for s in own]] = 1
    shared, size = x @ x.T, x.sum(axis=1)
    jaccard = shared / (size[:, None] + size[None, :] - shared)
    expected = int((jaccard >= 0.8).sum()) - 600
    assert jaccard.min() > 0.75 and np.median(jaccard) < 0.84
    found = sum(r["n_links"] for r in jaccard_join.jaccard_classes(docs_of(spark, rows)).collect())
    print("recall", found, expected)
    assert 0 <= expected - found <= 0.001 * expected


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_jaccard_links_at_lower_thresholds(spark, threshold):
    """Pairs all the way down to the threshold, against brute force."""
    rng = random.Random(17)
    rows = []
    for i in range(150):
        t = words(rng, 100).split()
        rows.append((2 * i, " ".join(t)))
        for x in rng.sample(range(100), rng.randrange(1, 14)):
            t[x] = f"edit{i}x{x}"
        rows.append((2 * i + 1, " ".join(t)))
    sets = [shingles(t) for _, t in rows]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 300, 2)]
    assert sum(threshold <= s < 0.8 for s in share) > 20
    found = sum(r["n_links"] for r in jaccard_join.jaccard_classes(docs_of(spark, rows), threshold=threshold).collect())
    assert found == 2 * sum(s >= threshold for s in share)


def test_jaccard_parameters_by_threshold():
    assert [jaccard_join.depth_of(t) for t in (0.95, 0.8, 0.65, 0.5, 0.3)] == [4, 4, 2, 1, 1]
    assert jaccard_join.likely_share(0.8) == pytest.approx(0.55)
    assert sorted(c for r in range(16) for c in jaccard_join.splits(r)) == list(range(64))


# --- op 1 -----------------------------------------------------------------


def test_class_lm_counts_and_base(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"W{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(60)))) for i in range(120)] + [(900, None), (901, ""), (902, "never seen")]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = Counter(w for _, t in train for w in [*(t or "").lower().split(), "\n"])
    n, v = sum(count.values()), len(count)
    got = class_lm.fit_and_score(docs_of(spark, rows), docs_of(spark, train), classes=8, unit_share=2e-3, known_share=1e-3).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        tokens = [*(t or "").lower().split(), "\n"]
        r = by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / len(tokens)), rel_tol=1e-9)


def test_class_lm_against_brute_force(spark, monkeypatch):
    """Tail classes, transitions and scores from plain counts over texts, and sums that are one."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "d", f"r{rng.randrange(60)}x", f"q{rng.randrange(200)}y"])
    train = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    asks = [*train[:20], (100, "a new word"), (101, None), (102, "a zzr1x b a q999y"), (103, train[0][1]), (None, "b c " * 4000), (104, "r1x " * 3)]
    seen, clustered = {}, []
    plain_cut, plain_exchange = class_lm.cut, class_lm.exchange_clustering
    monkeypatch.setattr(class_lm, "cut", lambda df, name: seen.setdefault(name, plain_cut(df, name)))
    monkeypatch.setattr(class_lm, "exchange_clustering", lambda *a, **k: clustered.append(plain_exchange(*a, **k)) or clustered[-1])
    k, share = 6, 0.05
    got = {r["doc_id"]: r for r in class_lm.fit_and_score(docs_of(spark, asks).withColumn("score", F.lit("clash")), docs_of(spark, train), classes=k, unit_share=share, known_share=0.004).collect()}
    assert len(got) == len(asks) and math.isclose(got[103]["score"], got[0]["score"], rel_tol=1e-12)

    tokens = [[*t.split(), "\n"] for _, t in train]
    count = Counter(w for t in tokens for w in t)
    total = sum(count.values())
    class_of, m = clustered[0]
    units = sorted((w for w in count if w != "\n" and count[w] >= share * total), key=lambda w: (-count[w], w))
    unit = {"\n": 0} | {w: i + 1 for i, w in enumerate(units)}
    first = {w: int(class_of[unit[w]] if w in unit else class_of[1 + len(units) + class_lm.stratum(w.encode())]) for w in count}
    cells = Counter((first[a], first[b]) for t in tokens for a, b in zip(["\n", *t[:-1]], t))
    assert all(m[x, y] == cells[x, y] for x in range(k) for y in range(k))
    # Each other word to its likeliest class.
    around = defaultdict(Counter)
    for t in tokens:
        for i, w in enumerate(t):
            if w not in unit:
                around[w]["before", first[t[i - 1]] if i else 0] += 1
                around[w]["after", first[t[i + 1]]] += 1

    def moves(m):
        columns, rows = m.sum(axis=0), m.sum(axis=1)
        return lambda x, y: (m[x, y] + class_lm.PRIOR * (columns[y] + 1) / (columns.sum() + k)) / (rows[x] + class_lm.PRIOR)

    p, of = moves(m), {w: first[w] for w in unit}
    for w in around:
        s = class_lm.stratum(w.encode())
        weights = [1e-3 + class_lm.STRATUM_WEIGHT * (class_of[1 + len(units) + s] == c) + sum(class_lm.stratum(u.encode()) == s and first[u] == c for u in units) for c in range(k)]
        value = [sum(n * math.log10(p(x, c) if side == "before" else p(c, x)) for (side, x), n in around[w].items()) - count[w] * math.log10(max(m[:, c].sum(), 1)) + math.log10(weights[c] / sum(weights)) for c in range(k)]
        of[w] = max(range(1, k), key=lambda c: (value[c], -c))
    assert {bytes(r["word"]).decode(): r["class"] for r in seen["tail-classes"].collect()} == {w: of[w] for w in around}

    final = np.zeros((k, k))
    for t in tokens:
        for a, b in zip(["\n", *t[:-1]], t):
            final[of[a], of[b]] += 1
    p, once, twice = moves(final), sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
    d = once / (once + 2 * twice)
    size, kinds = Counter(), Counter()
    for w, n in count.items():
        size[of[w]] += n
        kinds[of[w]] += w != "\n"
    hapaxes = Counter((class_lm.stratum(w.encode()), of[w]) for w in around if count[w] == 1)

    def stratum_class(w):
        s = class_lm.stratum(w.encode())
        found = [(n, -c) for (x, c), n in hapaxes.items() if x == s]
        return -max(found)[1] if found else int(class_of[1 + len(units) + s])

    def emission(w, c):
        if w == "\n":
            return 1.0
        return (count[w] - d) / size[c] if count[w] else (d * kinds[c] / size[c] if kinds[c] else 1.0)

    for i, t in asks:
        own = [*(t or "").split(), "\n"]
        classes = [of[w] if w in of else stratum_class(w) for w in own]
        expected = sum(math.log10(p(x, y)) + math.log10(emission(w, y)) for w, x, y in zip(own, [0, *classes[:-1]], classes))
        assert math.isclose(got[i]["score"], expected, rel_tol=1e-9), i
    for x in range(k):
        unseen = sum(p(x, c) * emission("never seen", c) for c in range(1, k))
        assert math.isclose(sum(p(x, of[w]) * emission(w, of[w]) for w in count) + unseen, 1, rel_tol=1e-9)


def test_exchange_only_raises_likelihood():
    rng = np.random.default_rng(6)
    m = rng.integers(0, 50, (6, 6)).astype(float)
    before = m.copy()
    right, left = rng.integers(0, 5, 6).astype(float), rng.integers(0, 5, 6).astype(float)
    m[2, :] += right
    m[:, 2] += left
    start = class_lm.likelihood(m)
    b = class_lm.best_class(m, 2, right, left, 0.0)
    assert class_lm.likelihood(m) >= start - 1e-9
    for c in range(1, 6):
        other = before.copy()
        other[c, :] += right
        other[:, c] += left
        assert class_lm.likelihood(other) <= class_lm.likelihood(m) + 1e-6, (b, c)


def test_class_lm_without_training(spark):
    got = class_lm.fit_and_score(docs_of(spark, [(1, "a b"), (2, None)]), docs_of(spark, [])).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in got] == [(0, 0)] * 2
    assert class_lm.fit_and_score(docs_of(spark, []), docs_of(spark, [(1, "a a b")])).count() == 0


def test_class_lm_beats_the_base_on_held_out(spark, sf):
    got = class_lm.op1_class_lm(spark, sf.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# --- op 5 -----------------------------------------------------------------


def test_quality_held_out(spark, sf):
    d = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_gam.op5_quality_gam(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_edges(spark):
    model = quality_gam.fit(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    rows = docs_of(spark, [(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000)]).withColumn("score", F.lit("clash"))
    got = quality_gam.quality_scores(rows, model).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) == 4
    assert quality_gam.quality_scores(docs_of(spark, []), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_gam.train(docs_of(spark, [(1, "a")]), empty).start == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(7)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, paired = (quality_gam.fit(x, y, pairs=k) for k in (0, 2))
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(paired) > 0.9 > 0.7 > right(alone)


# --- op 6 -----------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(8)
    mit = license_scan.TEMPLATES["MIT"]
    rows = [
        (1, f"{words(rng, 50)}\nReleased under the MIT License.\n{words(rng, 300)}"),
        (2, f"{words(rng, 20)} {mit.upper()} {words(rng, 20)}"),
        (3, f"{words(rng, 20)} {mit.replace('free of charge', 'at no cost')}"),
        (4, words(rng, 5000)), (5, None), (6, ""), (7, "license"), (1, "Released under the MIT License."),
    ]
    got = license_scan.license_matches(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "MIT notice"), (1, "MIT notice"), (2, "MIT"), (3, "MIT")]
    assert all(0.8 <= r["dice"] <= 1 for r in got) and {r["first_word"] for r in got if r["doc_id"] == 2} == {20}
    assert license_scan.license_matches(docs_of(spark, [])).count() == 0


def test_license_spans_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        template = set(range(6))
        text = [rng.choice([*range(6), 9, 9]) for _ in range(rng.randrange(2, 14))]
        where = np.array([i for i, c in enumerate(text) if c in template], dtype=np.int64)
        got = license_scan.spans(where, np.array([text[i] for i in where], dtype=np.int64), 6, 0.8)
        best = max((2 * len(template & set(text[a : b + 1])) / (b - a + 1 + 6) for a in range(len(text)) for b in range(a, len(text))), default=0)
        assert bool(got) == (best >= 0.8)
        if got:
            assert math.isclose(max(d for _, _, d in got), best)


def test_license_spans_equal_all_pairs_best_first():
    """Every (start, end) in order of coefficient, start and end; those that overlap a taken one go."""
    rng = random.Random(19)
    for _ in range(300):
        size = rng.choice([3, 6, 9])
        times = {c: rng.choice([1, 1, 2]) for c in range(size)}
        total, threshold = sum(times.values()), rng.choice([0.5, 0.8])
        text = [rng.choice([*range(size), *range(size), 99]) for _ in range(rng.randrange(2, 60))]
        where = np.array([i for i, c in enumerate(text) if c in times], dtype=np.int64)
        got = license_scan.spans(where, np.array([text[i] for i in where], dtype=np.int64), total, threshold, times)
        pairs = []
        for a, b in itertools.combinations_with_replacement(where.tolist(), 2):
            shared = sum(min(n, times.get(c, 0)) for c, n in Counter(text[a : b + 1]).items())
            if (dice := 2 * shared / (b - a + 1 + total)) >= threshold:
                pairs.append((-dice, a, b))
        taken = []
        for minus, a, b in sorted(pairs):
            if all(b < c or d < a for c, d, _ in taken):
                taken.append((a, b, -minus))
        assert got == sorted(taken)


def test_repeated_licenses_in_a_long_text(spark):
    """A text of 400 kB that is one licence again and again: every copy is found, in seconds."""
    mit = license_scan.TEMPLATES["MIT"]
    begun = time.monotonic()
    got = license_scan.license_matches(docs_of(spark, [(1, f"{mit}\n" * 600)]), {"MIT": mit}).collect()
    n = len(license_scan.normalised(mit).split())
    assert sorted((r["first_word"], r["n_words"]) for r in got) == [(i * n, n) for i in range(600)]
    assert all(r["dice"] == 1 for r in got) and time.monotonic() - begun < 30


# --- op 10 ----------------------------------------------------------------


def test_order_minhash_contract(spark):
    rng = random.Random(10)
    rows = [(3 * i, words(rng, rng.choice([1, 3, 40, 300]), 200)) for i in range(50)] + [(500, None), (501, ""), (502, "\t\n"), (503, "é" * 7), (6, rows_text := words(rng, 30)), (700, "a b " * 3000)]
    assert rows_text
    ordered = sorted((i, t or "") for i, t in rows)
    got = order_minhash.fingerprints(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(t) // 4
        expected[i, len(t), hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if 1000 < r["n_chars"] < 5000]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 + np.mean([r["near_next"] for r in long])
    blank = [r for r in got if r["doc_id"] in (500, 501, 502)]
    assert {r["fingerprint"] for r in blank} == {""}


def test_order_minhash_feels_order_and_repeats(spark):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(200)]
    moved = w[100:] + w[:100]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(moved)), (4, " ".join(w * 3))], "doc_id long, text string")
    sig = {r["doc_id"]: r["sig"] for r in order_minhash.with_signature(df, "text", "sig").collect()}
    assert rng and sig[1] == sig[2] and sig[1] != sig[4]
    share = len(set(sig[1]) & set(sig[3])) / len(sig[1])
    assert 0.2 < share < 0.9


def test_next_row_over_many_buckets(spark):
    keys = sorted(random.Random(12).sample(range(10_000), 400))
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in order_minhash.with_next(df, "doc_id", ["text"], bucket=16).collect()}
    assert got == {k: f"t{n}" for k, n in zip(keys, keys[1:] + keys[:1])}


def test_next_row_of_hot_and_repeated_keys(spark):
    """1,000 rows without an id, and equal rows: a cycle through all rows in several ranges, heads as asked for."""
    rng = random.Random(22)
    rows = [(None, words(rng, 6)) for _ in range(1000)] + [(i, words(rng, 6)) for i in range(200)] + [(7, "same text")] * 50 + [(None, "")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    head = (F.length("text") / 4).cast("int")
    got = order_minhash.with_next(df, "doc_id", ["text"], bucket=100).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows) and Counter(r["next_text"] for r in got) == Counter(t for _, t in rows)
    rank = lambda i: -1 if i is None else i
    of = {t: i for i, t in rows}
    assert all(rank(of[r["next_text"]]) - rank(r["doc_id"]) in (0, 1) for r in got if r["doc_id"] != 199)
    assert [of[r["next_text"]] for r in got if r["doc_id"] == 199] == [None]
    assert sum(r["next_text"] == "same text" for r in got if r["text"] == "same text") == 49
    cutoff = order_minhash.with_next(df, "doc_id", ["text"], bucket=100, heads={"text": head}).collect()
    assert Counter((r["text"], r["next_text"]) for r in cutoff) == Counter((r["text"], r["next_text"][: len(r["text"]) // 4]) for r in got)
    assert max(Counter(r["_portion"] for r in _places(spark, df)).values()) < 400


def _places(spark, df):
    """Rows of the last places that were written, with their range."""
    folder = order_minhash.cut(df.limit(0), "probe").inputFiles() or [order_minhash.cut(df.limit(1), "probe").inputFiles()[0]]
    root = folder[0].split("probe-")[0].removeprefix("file:")
    last = max(Path("/" + root.lstrip("/")).glob("places-*"), key=lambda p: p.stat().st_mtime)
    return spark.read.parquet(str(last)).collect()


def test_fingerprints_run_no_python(spark, sf):
    plan = order_minhash.op10_order_minhash(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_jaccard_classes_with_repeated_and_null_ids(spark):
    """Ids repeat with other texts or are null: links go by the text, no row is lost, one row of each class is first."""
    rng = random.Random(14)
    a, b = words(rng, 100), words(rng, 100)
    near = a.replace(a.split()[-1], "another")
    rows = [(5, a), (5, b), (7, near), (9, a), (None, near), (None, b), (None, words(rng, 50)), (9, a)]
    got = jaccard_join.jaccard_classes(docs_of(spark, rows).withColumn("class_id", F.lit("clash"))).collect()
    key = {r["text_key"]: None for r in got}
    assert len(got) == 8 and len(key) == 4
    links = Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"], r["is_first"]) for r in got)
    # a: ids 5, 9, 9; near: 7 and null; b: 5 and null; the last is alone.
    assert links == Counter([(5, 5, 4, 3, True), (9, 5, 4, 3, False), (9, 5, 4, 3, False), (7, 5, 4, 2, False), (None, 5, 4, 2, False), (5, 5, 1, 2, True), (None, 5, 1, 2, False), (None, None, 0, 1, True)])


def test_links_between_texts_without_ids(spark):
    a = words(random.Random(15), 100)
    got = jaccard_join.jaccard_classes(docs_of(spark, [(None, a), (7, a + " more"), (3, "x")])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in got) == [(0, 7, 1), (3, 3, 0), (7, 7, 1)]


def test_long_words_are_told_apart():
    x, y = "a" * 4096, "b" * 4096
    codes, _ = word_codes([(x + y).encode(), (y + x).encode()])
    assert codes[0] != codes[1]


def test_line_dedup_when_hashes_are_joined(spark):
    rng = random.Random(16)
    shared = [words(rng, 12) for _ in range(4)]
    rows = [(i, "\n".join([rng.choice(shared), words(rng, 15)])) for i in range(40)] + [(None, shared[0])]
    got = line_dedup.line_dedup(docs_of(spark, rows), bits=512).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    whole = line_dedup.line_dedup(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == deduped(rows[:-1])


def test_line_filters_do_not_fill(spark):
    """Far more lines than a fixed filter would have bits for: few are suspected, over several ranges."""
    rng = random.Random(17)
    shared = [words(rng, 12) for _ in range(20)]
    rows = [(i, "\n".join([f"line {i} {j} " + "x" * 40 for j in range(400)] + [shared[i % 20]])) for i in range(200)]
    for docs_a_range in (25, 20_000):
        n = line_dedup.suspected_hashes(docs_of(spark, rows), docs_a_range=docs_a_range).count()
        assert 20 <= n <= 20 + 0.03 * 80_000


def test_fingerprint_sketch_against_brute_force(spark):
    """Signatures from plain words and hashes, occurrences counted one by one."""
    import xxhash

    def chain(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=v < 0), seed)
        return seed

    def sketch(text):
        w = (text or "").split()
        bits = order_minhash.PLACE_BITS
        seen, codes = Counter(), []
        for i, x in enumerate(w):
            kmer = chain(x, w[i + 1] if i + 1 < len(w) else "") >> (bits + 1)
            n = seen[kmer]
            seen[kmer] += 1
            signed = chain(kmer, n) if n else None
            if n:
                # Spark hashes the long and then the int of the occurrence.
                h = xxhash.xxh64_intdigest(kmer.to_bytes(8, "little"), 42)
                signed = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h)
                kmer = signed >> (bits + 1)
            codes.append((kmer, i))
        out = []
        top = 63 - bits - order_minhash.BIN_BITS
        for b in sorted({k >> top for k, _ in codes}):
            two = sorted(sorted(c for c in codes if c[0] >> top == b)[:2], key=lambda c: c[1])
            out.append(b << 16 | chain(*[k for k, _ in two]) >> 48)
        return out

    rng = random.Random(18)
    texts = [words(rng, n, 30) for n in (0, 1, 2, 5, 40, 400)] + ["a b " * 700, "x " * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["sig"] for r in order_minhash.with_signature(df, "text", "sig").collect()}
    assert all(got[i] == sketch(t) for i, t in enumerate(texts))
    rows = docs_of(spark, [(i, t) for i, t in enumerate(texts * 2)]).withColumn("fingerprint", F.lit("clash"))
    prints = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(rows).collect()}
    assert all(prints[i] == prints[i + len(texts)] for i in range(len(texts)))
    assert order_minhash.fingerprints(docs_of(spark, [])).count() == 0


def test_fingerprints_of_texts_without_spaces(spark):
    rng = random.Random(19)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    code = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    rows = [(i, han(2000)) for i in range(6)] + [(10 + i, code(2000)) for i in range(6)] + [(20, "x" * 5000)]
    got = order_minhash.fingerprints(docs_of(spark, rows)).collect()
    # Both of a bin stay with (0.75 / 1.25) squared, 0.36.
    assert all(r["near_edited"] > 0.2 > 0.1 > r["near_next"] for r in got if r["doc_id"] not in (5, 15, 20))
    # An insertion near the start moves few cuts.
    base = code(3000)
    df = spark.createDataFrame([(1, base), (2, base[:50] + "inserted" + base[50:])], "doc_id long, text string")
    a, b = (r["sig"] for r in order_minhash.with_signature(df, "text", "sig").orderBy("doc_id").collect())
    assert len(set(a) & set(b)) > 0.7 * len(a)


def test_training_rows_stay_bounded(spark):
    rows = docs_of(spark, [(i % 4, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    plain = quality_gam.fit
    try:
        quality_gam.fit = lambda x, y, **k: seen.append(len(y)) or plain(x, y, **k)
        quality_gam.train(rows, labels, most_rows=2)
        quality_gam.train(rows, labels)
    finally:
        quality_gam.fit = plain
    assert seen[0] <= 2 and seen[1] <= 8


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("some terms")
    assert license_scan.read_templates(spark, str(tmp_path)) == {"a": "some terms"}
    (tmp_path / "b.txt").write_text("x" * 1_048_577)
    with pytest.raises(ValueError, match="larger than 1 MB"):
        license_scan.read_templates(spark, str(tmp_path))


def test_whole_licenses_and_repeated_bigrams(spark):
    rng = random.Random(20)
    full = license_scan.TEMPLATES["BSD-3-Clause full"]
    rows = [(1, f"{words(rng, 400)} {full} {words(rng, 400)}"), (2, full.replace("COPYRIGHT HOLDER", "REGENTS")), (None, "the software " * 5000)]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.license_matches(docs_of(spark, rows)).collect()}
    assert got[1, "BSD-3-Clause full"]["dice"] > 0.99 and got[1, "BSD-3-Clause full"]["first_word"] == 400
    assert (2, "BSD-3-Clause full") in got and not any(i is None for i, _ in got)
    same = license_scan.license_matches(docs_of(spark, [(1, "one two one two one two")]), {"echo": "one two one two one two"}).first()
    assert same["dice"] == 1
