"""Kept features, the commit log, and publishing by several writers."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomplan.sources import commits, feature_store
from loomplan.sources.feature_store import FeatureStore, Model

IMAGES = "id string, item_type string, content binary"
MODEL = Model("means", "r1", "v1", 3)


def decoder():
    def decode(content):
        if not content.startswith(b"#"):
            raise ValueError("no picture")
        return np.full((40, 40, 3), list(content[1:4]), dtype=np.uint8)

    return decode


#: Made within a function, so that it travels to tasks by value.
decode = decoder()


def counting(folder):
    """An encoder that leaves a file for each picture of a product's whole view that it sees."""

    def encoder():
        def encode(pictures):
            for p in pictures:
                if p.shape[0] == 40:
                    with open(f"{folder}/seen", "a") as f:
                        f.write(f"{p[0, 0].tolist()}\n")
            return np.array([p.reshape(-1, 3).mean(axis=0) + 1 for p in pictures])

        return encode

    return encoder


def seen(folder):
    path = folder / "seen"
    out = sorted(path.read_text().splitlines()) if path.exists() else []
    path.unlink(missing_ok=True)
    return out


def test_only_missing_images_are_encoded(spark, tmp_path):
    rows = [("a", "OTSH", b"#abc"), ("a2", "OTSH", b"#abc"), ("b", "OTTR", b"#xyz"), ("bad", "OTSH", b"broken"), ("none", "OTSH", None), (None, None, b"#kkk"), ("empty", "", b"")]
    images = spark.createDataFrame(rows, IMAGES).withColumns({"vector": F.lit(1), "issue": F.lit("mine"), "cache_key": F.lit("clash")})
    store = FeatureStore(spark, str(tmp_path / "store"))
    first = store.refresh(images, MODEL, decode, counting(tmp_path))
    assert sorted(str(r["id"]) for r in first.features.collect()) == ["None", "a", "a2", "b"]
    assert {r["id"]: r["issue"] for r in first.issues.collect()} == {"bad": "not_decodable: ValueError", "none": "empty", "empty": "empty"}
    assert len(seen(tmp_path)) == 3 and store.cache().count() == 3
    vectors = {r["id"]: r["vector"] for r in first.features.collect()}
    assert vectors["a"] == vectors["a2"] and abs(np.linalg.norm(vectors["b"]) - 1) < 1e-6

    again = store.refresh(images, MODEL, decode, counting(tmp_path))
    assert seen(tmp_path) == [] and again.features.where("not reused").isEmpty()
    assert {r["id"]: r["vector"] for r in again.features.collect()} == vectors and again.issues.count() == 3

    more = images.select("id", "item_type", "content").union(spark.createDataFrame([("new", "OTSH", b"#new")], IMAGES))
    third = store.refresh(more, MODEL, decode, counting(tmp_path))
    assert seen(tmp_path) == [str(list(b"new"))] and {r["id"] for r in third.features.where("not reused").collect()} == {"new"}
    assert len(commits.entries(spark, str(tmp_path / "store"))) == 2

    other = store.refresh(images, Model("means", "r2", "v1", 3), decode, counting(tmp_path))
    assert len(seen(tmp_path)) == 3 and other.features.where("reused").isEmpty()


def test_one_image_of_two_types_is_refused_before_encoding(spark, tmp_path):
    images = spark.createDataFrame([("a", "OTSH", b"#abc"), ("b", "OTTR", b"#abc")], IMAGES)
    with pytest.raises(ValueError, match="two item types"):
        FeatureStore(spark, str(tmp_path / "s")).refresh(images, MODEL, decode, counting(tmp_path))
    assert seen(tmp_path) == []


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    images = spark.createDataFrame([("a", "OTSH", b"#abc")], IMAGES)
    with pytest.raises(Exception, match="another number or dimension"):
        store.refresh(images, Model("means", "r1", "v1", 7), decode, counting(tmp_path)).features.collect()
    assert store.cache().isEmpty() and commits.entries(spark, str(tmp_path / "s")) == []
    none = feature_store.refresh(images.limit(0), store.cache(), MODEL, decode, counting(tmp_path))
    assert none.features.isEmpty() and none.issues.isEmpty() and none.cache.isEmpty()


def test_one_writer_wins_each_number(spark, tmp_path):
    root, won = str(tmp_path / "log"), []
    writers = [threading.Thread(target=lambda i=i: won.append(commits.commit(spark, root, lambda before: {"writer": i, "after": len(before)}))) for i in range(8)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    found = commits.entries(spark, root)
    assert [n for n, _ in found] == list(range(1, 9)) and sorted(e["writer"] for _, e in found) == list(range(8))
    assert all(e["after"] == n - 1 for n, e in found) and sorted(n for n, _ in won) == list(range(1, 9))
    assert not commits.put_if_absent(spark, f"{root}/_log/{1:020d}.json", "{}")
