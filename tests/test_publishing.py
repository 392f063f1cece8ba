"""Builds by several publishers, pages, and the published document."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from loomplan.sources import artifact, commits, publish


def build(spark, name):
    return {"historical": spark.range(3).withColumn("build", F.lit(name)), "upcoming": spark.range(2).withColumn("build", F.lit(name))}


def test_two_publishers_at_once_leave_one_whole_active_build(spark, tmp_path):
    root, numbers = str(tmp_path / "builds"), {}

    def run(name):
        numbers[name] = publish.publish(build(spark, name), root, name, "2026-01-01")

    writers = [threading.Thread(target=run, args=(f"b{i}",)) for i in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(numbers.values()) == [1, 2, 3]
    active = max(numbers, key=numbers.get)
    for table, n in (("historical", 3), ("upcoming", 2)):
        assert [r["build"] for r in publish.load_active(spark, root, table).collect()] == [active] * n
    assert {r["build_id"]: r["number"] for r in publish.builds(spark, root).collect()} == numbers


def test_a_loser_is_looked_at_again(spark, tmp_path, monkeypatch):
    """Between a publisher's look at the log and its entry, others commit."""
    root = str(tmp_path / "builds")
    publish.publish(build(spark, "b1"), root, "b1", "2026-01-01")
    publish.publish(build(spark, "b2"), root, "b2", "2026-01-02")
    put, raced = commits.put_if_absent, []

    def late(other):
        def put_late(spark, path, text):
            if not raced:
                raced.append(path)
                other()
            return put(spark, path, text)

        return put_late

    monkeypatch.setattr(commits, "put_if_absent", late(lambda: publish.publish(build(spark, "b3"), root, "b3", "2026-01-03")))
    assert publish.publish(build(spark, "b4"), root, "b4", "2026-01-04") == 4
    raced.clear()
    monkeypatch.setattr(commits, "put_if_absent", late(lambda: publish.publish(build(spark, "b5"), root, "b5", "2026-01-05")))
    with pytest.raises(publish.Conflict, match="isn't the active one"):
        publish.publish(build(spark, "b6"), root, "b6", "2026-01-06", replaces="b4")
    raced.clear()
    monkeypatch.setattr(commits, "put_if_absent", late(lambda: publish.remove_superseded(spark, root)))
    with pytest.raises(publish.Conflict, match="history of build b1"):
        publish.publish(build(spark, "b7"), root, "b7", "2026-01-07", historical_build="b1")
    assert {r["build"] for r in publish.load_active(spark, root, "upcoming").collect()} == {"b5"}
    assert {r["build_id"] for r in publish.builds(spark, root).where("removed").collect()} == {"b1", "b2", "b3", "b4"}
    with pytest.raises(publish.Conflict, match="already"):
        publish.publish(build(spark, "b5"), root, "b5", "2026-01-08")


def test_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    ordinals = [*range(0, 400, 4), 100, 100]
    publish.write_pages(spark.createDataFrame([(o, f"p{o}") for o in ordinals], "ordinal long, id string"), path, files=7)
    seen, cursor = [], None
    while True:
        page = publish.read_page(spark, path, cursor, 15)
        rows = page.orderBy("ordinal").collect()
        assert len(rows) <= 17
        seen += [r["ordinal"] for r in rows]
        cursor = rows[-1]["next_cursor"]
        if cursor is None:
            break
    assert seen == sorted(ordinals)
    plan = publish.read_page(spark, path, 101, 15)._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "GreaterThan(ordinal,101)" in physical and "LessThanOrEqual(ordinal," in physical and "Sort" not in physical and "Offset" not in physical
    read = publish.read_page(spark, path, 101, 15).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2
    assert publish.read_page(spark, path, 396, 15).collect() == [] and len(publish.read_page(spark, path, None, 9_999).collect()) == len(ordinals)
    publish.write_pages(spark.createDataFrame([], "ordinal long, id string"), path + "-none")
    assert publish.read_page(spark, path + "-none", None).collect() == []
    with pytest.raises(ValueError, match="have no page"):
        publish.write_pages(spark.createDataFrame([(None, "x")], "ordinal long, id string"), path + "-null")


def test_document_in_parts(spark, tmp_path):
    path = str(tmp_path / "document")
    history = spark.createDataFrame([(i, f"H{i}", "OTSH", "A", "X", "cotton", "NAVY", True, 100, 110, 90, 0.9, 70, 0.0, -1.5 if i else None, i == 1) for i in range(40)], "ordinal long, id string, item_type string, category_type string, design string, fabric string, colour string, has_image boolean, order_qty long, dispatch_qty long, sales_qty long, sell_through double, ageing_days long, weekly_sell_through double, weekly_log_rate double, demand_censored boolean")
    old = artifact.historical_documents(history)
    counts = artifact.write_artifact(spark.createDataFrame([(40, 40)], "historical_items long, upcoming_items long"), old, old.withColumn("ordinal", -F.col("ordinal")), path, parts=3)
    assert counts == {"historical": 40, "upcoming": 40}
    assert artifact.read_artifact(spark, path, "historical", old).exceptAll(old.select("document")).isEmpty()
    manifest = json.loads((tmp_path / "document" / "manifest.json").read_text())
    lines = [json.loads(x) for p in manifest["upcoming"] for x in (tmp_path / "document" / "upcoming" / p["part"]).read_text().splitlines()]
    assert len(manifest["historical"]) == 3 and [x["id"] for x in lines] == [f"H{i}" for i in reversed(range(40))]
    assert list(lines[-1]) == ["id", "sourceId", "itemType", "style", "colourCode", "design", "categoryType", "fabric", "season", "colour", "imageUrl", "hasVisualFeature", "order", "dispatch", "sales", "sellThrough", "ageingDays", "weeklySellThrough", "weeklyLogRate", "demandCensored", "qualityFlags"]
    assert lines[-1]["weeklyLogRate"] is None and lines[0]["qualityFlags"] == ["dispatch_above_order"]
    with pytest.raises(Exception, match="(?i)exists"):
        artifact.write_artifact(spark.range(1), old, old, path)
