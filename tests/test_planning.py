"""The planning operators on small tables, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomplan.operators import demand, images, recommend, similarity, validate
from loomplan.plans.matching import Matching
from loomplan.plans.queries import QUERIES
from loomplan.policy import MatchPolicy
from loomplan.sources import catalogues, publish
from loomplan.streaming.scoring import score_stream

HISTORY = "id string, item_type string, category_type string, order_qty long, dispatch_qty long, sales_qty long, sell_through double, ageing_days long, weekly_sell_through double"


def synthetic(spark, item_type="OTSH", n=40):
    rows = []
    for i in range(n):
        order = 600 + 20 * i
        sold = int(order * (0.45 + 0.01 * (i % 20)))
        rows.append((f"H{i}", item_type, "FORMAL", order, order, sold, sold / order, 266, 0.0))
    return spark.createDataFrame(rows, HISTORY)


def forecast(spark, history, matches):
    f = demand.fit_demand(history)
    up = spark.createDataFrame([("U", "OTSH", "FORMAL")], "id string, item_type string, category_type string")
    found = spark.createDataFrame([("U", r, s, k + 1) for k, (r, s) in enumerate(matches)], "left_id string, right_id string, visual_score double, match_rank int")
    return demand.pooled_demand(up, found, f["history"], f["priors"], f["tau"].scalar(), f["horizon"].scalar()).collect()


def test_more_analogues_weigh_more(spark):
    h = synthetic(spark)
    strong, weak = forecast(spark, h, [(f"H{i}", 0.88) for i in range(4)])[0], forecast(spark, h, [("H1", 0.51)])[0]
    assert weak["effective_n"] < strong["effective_n"] and weak["shrinkage_weight"] < strong["shrinkage_weight"]
    assert strong["p10"] < strong["point_demand"] < strong["p90"]
    assert forecast(spark, h, [("gone", 0.9)]) == []
    # The fifth best doesn't stand in for one of the best four that can't be used.
    assert forecast(spark, h, [("H1", 0.9), ("gone", 0.9), ("H2", 0.9), ("H3", 0.9), ("H4", 0.9)])[0]["analogues_used"] == 3


def test_sold_out_products_are_lifted(spark):
    h = synthetic(spark).union(spark.createDataFrame([("S", "OTSH", "FORMAL", 500, 500, 499, 499 / 500, 266, 0.0)], HISTORY))
    rows = {r["id"]: r for r in demand.fit_demand(h)["history"].collect()}
    assert rows["S"]["demand_censored"] and rows["S"]["corrected_rate"] > rows["S"]["rate"]
    assert rows["H3"]["corrected_rate"] == rows["H3"]["rate"]


def test_ceilings_and_horizon(spark):
    h = spark.createDataFrame([("a", "OTSU", "", 2000, 0, 1600, 0.8, 70, 0.0), ("b", "OTTR", "", 15000, 0, 12000, 0.8, 140, 0.0), ("c", None, "", 10, 0, 5, 0.5, 0, 0.0)], HISTORY)
    got = {r[0]: r[1] for r in demand.buy_ceilings(h).collect()}
    assert got == {"OTSU": 2500.0, "OTTR": 18750.0, "": 500.0, None: 18750.0}
    assert demand.horizon_weeks(h).first()[0] == 20.0  # the upper of two
    assert demand.horizon_weeks(h.limit(0)).first()[0] == 38.0


def test_single_analogue_rule(spark):
    h = spark.createDataFrame([("H", "OTSH", "FORMAL", 625, 600, 525, 0.875, 266, 0.0)], HISTORY)
    up = spark.createDataFrame([("U", "OTSH"), ("V", "OTSH")], "id string, item_type string")
    m = spark.createDataFrame([("U", "H", 0.9, 0.9, 1), ("V", "H", 0.1, 0.1, 1)], "left_id string, right_id string, visual_score double, hybrid_score double, match_rank int")
    got = {r["id"]: r for r in recommend.single_analogue(up, m, h).collect()}
    assert (got["U"]["expected_sales"], got["U"]["quantity"], got["U"]["analogue_quantity"]) == (525, 750, 625)
    assert got["V"]["no_match"] and got["V"]["quantity"] == 0


def items(spark, rows):
    return spark.createDataFrame([(i, k, t, d, [float(x) for x in v]) for k, (i, t, d, v) in enumerate(rows)], "id string, ordinal long, item_type string, design string, vector array<double>")


def test_cohort_topk(spark):
    red, green = (1, 0, 0), (0, 1, 0)
    h = items(spark, [("a", "OTSH", "CHECKS", red), ("b", "otsh ", "CHECKS", green), ("c", "OTSH", "CHECKS", red), ("d", "OTTR", "CHECKS", red), ("e", "", "CHECKS", red)])
    q = items(spark, [("q", "OTSH", "CHECKS", red), ("r", None, "CHECKS", red)])
    for block in (1, 2, 100):
        got = similarity.cohort_topk(q, h, 2, block=block).orderBy("left_id", "retrieval_rank").collect()
        assert [(r["left_id"], r["right_id"], r["retrieval_rank"]) for r in got] == [("q", "a", 1), ("q", "c", 2)]
    assert similarity.cohort_topk(q, h.limit(0), 2).count() == 0


def test_gates(spark):
    rows = [("q", "a", 1, "OTSH", "CHECKS", "CHECKS", 0.0, 0.0), ("q", "b", 2, "OTSH", "CHECKS", "CHECKS", 0.5, 0.0), ("q", "c", 3, "OTSH", "CHECKS", "CHECKS", 0.0, 0.9), ("q", "d", 4, "OTSH", "X", "X", None, 0.0), ("t", "a", 1, "OTTR", "PLAINS", "PLAINS", 0.1, 0.9)]
    pairs = spark.createDataFrame(rows, "left_id string, right_id string, retrieval_rank int, left_item_type string, left_design string, right_design string, colour_distance double, pattern_distance double")
    gated = similarity.gated_pairs(pairs, MatchPolicy())
    assert sorted(tuple(r) for r in similarity.accepted_pairs(gated).select("left_id", "right_id", "candidate_rank").collect()) == [("q", "a", 1), ("t", "a", 1)]
    queries = spark.createDataFrame([("q", "OTSH"), ("t", "OTTR"), ("u", "")], "id string, item_type string")
    audit = {r["item_type"]: r for r in similarity.gate_audit(queries, gated).collect()}
    assert (audit["OTSH"]["colour_rejected"], audit["OTSH"]["pattern_rejected"], audit["OTTR"]["pattern_bypassed"], audit["UNSPECIFIED"]["without_accepted"], audit["(all)"]["queries"]) == (2, 1, 1, 1, 3)


def test_gates_see_as_many_candidates_as_the_policy_says(spark, sf):
    """Cohorts of the smallest tables have up to 31 products with a vector, all of them under the policy's 50."""
    m = Matching(spark, sf)
    cohort = similarity.cohort_key()
    sizes = m.right.groupBy(cohort.alias("c")).agg(F.least(F.count("*"), F.lit(MatchPolicy().candidates)).alias("n"))
    expected = m.left.select(cohort.alias("c")).join(sizes, "c").agg(F.sum("n"), F.max("n")).first()
    got = QUERIES["gate_audit"](spark, sf).where("item_type = '(all)'").first()
    assert expected[1] > 10 and got["retrieved"] == expected[0]


def test_whole_one_stage_against_brute_force(spark):
    """70 near of the own item type don't hide the nearest, of another; all pairs calibrate."""
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 4)))
    h, q = unit(90), unit(3)
    h[80] = q[0]
    right = items(spark, [(f"H{i}", "OTSH" if i < 70 else "OTTR", "X", v) for i, v in enumerate(h)])
    left = items(spark, [(f"Q{i}", "OTSH", "X", v) for i, v in enumerate(q)])
    d = np.round(np.clip(1 - q @ h.T, 0, 2), 7)
    q10, median, q90 = np.percentile(d, [10, 50, 90])
    scale = (q90 - q10) / (2 * np.log(9))
    score = np.round(1 / (1 + np.exp((d - median) / scale)), 4)
    products = left.select("id").union(spark.createDataFrame([("blind",)], "id string"))
    for block in (7, 4096):
        assert similarity.all_pairs_calibration(left, right, block=block) == pytest.approx((270, median, scale))
        got = {(r["left_id"], r["match_rank"]): r for r in similarity.whole_one_stage(left, right, products, 4, block=block).collect()}
        assert len(got) == 16 and got["Q0", 1]["right_id"] == "H80"
        for i in range(3):
            expected = np.argsort(-score[i], kind="stable")[:4]
            assert [got[f"Q{i}", r + 1]["right_id"] for r in range(4)] == [f"H{j}" for j in expected]
            assert [got[f"Q{i}", r + 1]["visual_score"] for r in range(4)] == pytest.approx(score[i, expected], abs=2e-4)
        assert [(got["blind", r]["right_id"], got["blind", r]["visual_score"]) for r in range(1, 5)] == [(f"H{j}", None) for j in range(4)]


def test_palette_distance(spark):
    red, blue, none = [50.0, 60.0, 40.0, 1.0] + [0.0] * 12, [30.0, 50.0, -90.0, 1.0] + [0.0] * 12, [0.0] * 16
    df = spark.createDataFrame([(0, red, red), (1, red, blue), (2, none, none), (3, red, none), (4, red, None)], "i int, a array<double>, b array<double>")
    got = [r[0] for r in df.orderBy("i").select(similarity.palette_distance("a", "b")).collect()]
    assert got[0] == 0 and got[1] > 0.2 and got[2:] == [0.0, 2.0, None]


def test_light_palette_entries_count_as_in_the_sql(spark, tmp_path):
    """A weight under 1e-6 is a colour like any other in the tables' palettes."""
    import duckdb

    v = np.random.default_rng(6).normal(size=(3, 64)) / 8
    v[1, 3], v[2, 7] = 1e-7, -3e-7
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(3).selectExpr("id as p_partkey", "'T' as p_type", "'B' as p_brand").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    for t in ("part", "embeddings"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    expected = db.execute(__spark_entry__.oracle_sql()["palette_distance"]).fetchall()
    assert sorted(map(tuple, QUERIES["palette_distance"](spark, str(tmp_path)).collect())) == sorted(expected)


CSV = "product_id,season,item_type,style_code,colour_code,design,category_type,fabric,colour,collection_world\n"


def test_catalogue_files(spark, tmp_path):
    path = tmp_path / "new.csv"
    path.write_text("﻿" + CSV + 'OTSH-200-1002,SS27,OTSH,200,1002,PLAINS,FORMAL,Cotton,"BLUE, ""deep""",PRO\n,,,,,,,,,\nOTSH-200-1002,SS27,OTSH,200,1002,PLAINS,FORMAL,Cotton,BLUE,PRO\nBAD,SS27,OTSH,,,,OTHER,,,\n')
    rows = catalogues.read_catalogue(spark, str(path), historical=False)
    assert rows.count() == 3
    checked = validate.validated(rows, historical=False)
    codes = [[i["code"] for i in r["issues"]] for r in checked.orderBy("ordinal").collect()]
    assert codes == [[], ["duplicate_identifier"], ["invalid_identifier", "invalid_category"]]
    with pytest.raises(validate.CatalogueError):
        catalogues.read_catalogue(spark, str(path), historical=True)
    with pytest.raises(validate.CatalogueError):
        catalogues.read_catalogue(spark, str(path), historical=False, most_rows=2)
    assert catalogues.dedupe_names(["A", "B", "A", "A"]) == ["A", "B", "A__2", "A__3"]
    for name, data in (("x.png", b"1"), ("X.jpg", b"2"), ("y.txt", b"3")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].split("/")[-1]: r["issue"] for r in catalogues.images(spark, str(tmp_path)).collect()}
    assert (got["X.jpg"], got["x.png"], got["y.txt"]) == (None, "duplicate_stem", "unsupported_suffix")


def test_publish_and_features(spark, tmp_path):
    root = str(tmp_path / "builds")
    for build, created in (("b1", "2026-01-01"), ("b2", "2026-02-01")):
        publish.publish({"upcoming": spark.range(3).withColumn("build", F.lit(build))}, root, build, created)
    with pytest.raises(ValueError):
        publish.publish({"upcoming": spark.range(0)}, root, "b3", "2026-03-01")
    assert {r["build"] for r in publish.load_active(spark, root, "upcoming").collect()} == {"b2"}
    publish.save_features(spark.range(2), str(tmp_path / "features"), "m1")
    assert publish.load_features(spark, str(tmp_path / "features"), "m1").count() == 2
    with pytest.raises(ValueError):
        publish.load_features(spark, str(tmp_path / "features"), "m2")


def picture(colour):
    out = np.full((40, 40, 3), 255, dtype=np.uint8)
    out[6:34, 6:34] = colour
    return out.tobytes()


def test_images(spark):
    def decode(content):
        return np.frombuffer(content, dtype=np.uint8).reshape(40, 40, 3)

    df = spark.createDataFrame([("r", "OTSH", picture((200, 0, 0))), ("s", "OTSH", picture((190, 20, 20))), ("b", "OTSH", picture((0, 0, 200))), ("x", "OTSH", b"bad")], "id string, item_type string, content binary")
    got = {r["id"]: r for r in images.appearance_features(df, decode).collect()}
    assert got["x"]["palette"] is None and len(got["r"]["texture"]) == 16
    pairs = spark.createDataFrame([(got["r"]["palette"], got["s"]["palette"]), (got["r"]["palette"], got["b"]["palette"])], "a array<double>, b array<double>")
    near, far = (r[0] for r in pairs.select(similarity.palette_distance("a", "b")).collect())
    assert near < far and far > 0.2

    def encoder():
        return lambda pictures: np.array([p.reshape(-1, 3).mean(0) / p.reshape(-1, 3).mean(0).sum() for p in pictures])

    vectors = images.batch_embed(df.where("id <> 'x'").union(df.where("id = 'r'")), decode, encoder, dimension=3).collect()
    assert len(vectors) == 3 and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 and len(r["pattern"]) == 9 for r in vectors)
    assert images.pad_to_square(np.zeros((40, 80, 3), dtype=np.uint8)).shape == (80, 80, 3)
    assert images.region(np.zeros((100, 100, 3)), "OTTR").shape[:2] == (52, 68)


def test_stream(spark, tmp_path):
    schema = "id string, arrived timestamp"
    spark.createDataFrame([("a", None), ("b", None)], schema).withColumn("arrived", F.lit("2026-01-01 00:00:00").cast("timestamp")).union(spark.sql("select 'a', timestamp '2026-01-01 00:10:00'")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df: df.withColumn("score", F.length("id")), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["id", "best_id", "match_confidence", "expected_sales", "quantity", "quantity_capped"]


def test_plans(spark, sf):
    from loomplan.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("cohort_topk") and "CartesianProduct" not in plan("cohort_topk")
    # The counts of weeks are written by one scan and read from there.
    assert plan("horizon_weeks").count("lineitem.parquet") <= 1


def test_saved_features_of_two_models(spark, tmp_path):
    path = str(tmp_path / "both")
    publish.save_features(spark.range(2), path, "m1")
    publish.save_features(spark.range(3), path, "m2")
    publish.save_features(spark.range(5), path, "m2")
    assert (publish.load_features(spark, path, "m1").count(), publish.load_features(spark, path, "m2").count()) == (2, 5)


def test_superseded_builds(spark, tmp_path):
    root = str(tmp_path / "builds")
    for build, created, history in (("b1", "2026-01-01", None), ("b2", "2026-02-01", None), ("b3", "2026-03-01", "b1")):
        publish.publish({"upcoming": spark.range(2)}, root, build, created, historical_build=history)
    assert publish.remove_superseded(spark, root) == ["b2"]
    assert {p.name for p in (tmp_path / "builds").glob("build_id=*")} == {"build_id=b1", "build_id=b3"}
    assert publish.load_active(spark, root, "upcoming").count() == 2


def test_blank_rows_have_no_number(spark, tmp_path):
    path = tmp_path / "new.csv"
    path.write_text(CSV + ",,,,,,,,,\nOTSH-200-1002,SS27,OTSH,200,1002,PLAINS,FORMAL,Cotton,BLUE,PRO\n,,,,,,,,,\n,SS27,OTSH,200,1002,PLAINS,FORMAL,Cotton,BLUE,PRO\n,SS27,OTSH,,,,FORMAL,,,\n")
    checked = validate.validated(catalogues.read_catalogue(spark, str(path), historical=False), historical=False).orderBy("ordinal").collect()
    assert [(r["row_number"], [i["code"] for i in r["issues"]]) for r in checked] == [(2, []), (3, ["invalid_identifier"]), (4, ["invalid_identifier"])]


LEGACY = "CC (SEG-1+2+3),SEGMENT1,SEGMENT2,SEGMENT3,CAT1,COLOUR NAME,CAT4,CAT-3,WORLD,MRP\n"


def test_legacy_layouts(spark, tmp_path):
    for name, header in (("old.csv", LEGACY), ("images.csv", LEGACY.replace("CC (SEG-1+2+3)", "image  id").replace("COLOUR NAME", "COLOR_NAME").replace("CAT-3", "CAT3"))):
        (tmp_path / name).write_text(header + "OTSU51021001F2PC,OTSU,5102,1001,PLAINS,NAVY,100% Cotton,TAILORED,PRO,999\n")
        rows = catalogues.read_catalogue(spark, str(tmp_path / name), historical=False)
        assert rows.columns == [*catalogues.UPCOMING, "ordinal"]
        got = validate.validated(rows, historical=False).first()
        assert (got["product_id"], got["season"], got["category_type"], got["fabric"], got["colour"], got["issues"]) == ("OTSU-5102-1001", "SS27", "FORMAL", "Cotton – 100%", "NAVY", [])
    old = ["CON", "SEASON", "ITEM TYPE", "SORT", "COLOR", "CAT1", "CAT3", "CAT4", "CAT5", "COLOR", "MAX", "PT", "RIL", "TOTAL ORDER", "DISPATCH", "SALE", "1ST DISPATCH", "AGEING", "SELL THR", "WKLY SELL THRU", "PROV"]
    (tmp_path / "h.csv").write_text(",".join(old) + "\nOTSH-100-1001,AW25,OTSH,100,1001,PLAINS,CEREMONIAL,PVS,X,NAVY,1,2,3,500,500,350,,140,70%,0.035,P\n")
    got = validate.validated(catalogues.read_catalogue(spark, str(tmp_path / "h.csv"), historical=True), historical=True).first()
    assert (got["colour_code"], got["colour"], got["total_order_quantity"], got["sell_through"], got["issues"]) == ("1001", "NAVY", 500, 0.7, [])
    (tmp_path / "odd.csv").write_text(LEGACY.replace("MRP", "OTHER") + "a,b,c,d,e,f,g,h,i,j\n")
    with pytest.raises(validate.CatalogueError, match="product_id: not there"):
        catalogues.read_catalogue(spark, str(tmp_path / "odd.csv"), historical=False)


def test_nothing_left_is_an_error(spark):
    from loomplan.operators import features

    rows = spark.createDataFrame([("a", 0, "OTSH")], "id string, sales_qty int, item_type string")
    with pytest.raises(features.NothingLeft):
        features.exclude_zero_sales(rows)
    with pytest.raises(features.NothingLeft):
        features.with_history(rows, rows.withColumn("item_type", F.lit("OTTR")))
    bad = spark.createDataFrame([("BAD", "FORMAL", "", 0)], "product_id string, category_type string, fabric string, ordinal long")
    with pytest.raises(validate.CatalogueError, match="row 2.*invalid_identifier"):
        validate.clean_rows(validate.validated(bad, historical=False), must=True)


def test_cohort_larger_than_two_blocks_on_each_side(spark):
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 5)))
    h, q = unit(70), unit(40)
    h[50] = h[3]
    right, left = items(spark, [(f"H{i}", "OTSH", "X", v) for i, v in enumerate(h)]), items(spark, [(f"Q{i}", "OTSH", "X", v) for i, v in enumerate(q)])
    got = {(r["left_id"], r["retrieval_rank"]): r["right_id"] for r in similarity.cohort_topk(left, right, 6, block=13).collect()}
    d = 1 - q @ h.T
    d[:, 50] = d[:, 3]
    assert got == {(f"Q{i}", k + 1): f"H{j}" for i in range(40) for k, j in enumerate(np.argsort(d[i], kind="stable")[:6])}


def test_exact_percentiles(spark):
    from loomplan.operators.quantiles import exact_percentiles

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0], [90, 11]), "c": np.array([5.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)], "k string, x double")
    got = {r["k"]: r for r in exact_percentiles(rows, ["k"], "x", [0.1, 0.5, 0.9]).collect()}
    assert set(got) == set(values) and all(got[k]["n"] == len(v) and got[k]["q"] == pytest.approx(np.percentile(v, [10, 50, 90]).tolist(), abs=1e-12) for k, v in values.items())


def test_chosen_analogue_leads(spark):
    h = synthetic(spark).withColumn("has_image", F.lit(True))
    f = demand.fit_demand(h)
    m = "array<struct<match_rank:int,historical_id:string,visual_score:double,hybrid_score:double>>"
    published = spark.createDataFrame([("U", "OTSH", "FORMAL", [(1, "H1", 0.9, 0.9), (2, "H30", 0.7, 0.7), (3, "H2", 0.4, 0.4)])], f"id string, item_type string, category_type string, matches {m}")
    settings = spark.createDataFrame([(1, 0.5, 0.7), (2, 0.8, 0.7), (3, 0.95, 0.7)], "setting_id int, minimum double, target double")
    chosen = spark.createDataFrame([("U", "H30")], "id string, historical_id string")
    decide = lambda picks: {r["setting_id"]: r for r in recommend.what_if(published, settings, f["history"].withColumn("has_image", F.lit(True)), f["priors"], f["ceilings"], f["tau"].scalar(), f["horizon"].scalar(), chosen=picks).collect()}
    plain, picked = decide(None), decide(chosen)
    assert [plain[i]["best_id"] for i in (1, 2, 3)] == ["H1", "H1", None] and [picked[i]["best_id"] for i in (1, 2, 3)] == ["H30", "H1", None]
    # The forecast pools all that are eligible, whichever leads.
    assert picked[1]["quantity"] == plain[1]["quantity"] > 0 and picked[1]["analogue_sales"] > plain[1]["analogue_sales"]
    assert (plain[1]["match_confidence"], picked[1]["match_confidence"], plain[3]["match_confidence"], plain[3]["quantity"]) == ("High", "Medium", "Low", 0)
    with pytest.raises(ValueError):
        recommend.what_if(published, spark.range(2000).selectExpr("id as setting_id", "0.5 as minimum", "0.5 as target"), f["history"], f["priors"], f["ceilings"], F.lit(1.0), F.lit(1.0))


def test_planner_state(spark):
    log = spark.createDataFrame([
        (1, 1, "override", "a", 50), (1, 2, "approve", "a", None), (1, 3, "approve", "b", None), (1, 4, "settings", None, None), (1, 5, "override", "a", 75), (1, 6, "approve", "c", None),
        (1, 7, "choose", "c", None), (1, 8, "approve", "d", None), (2, 1, "approve", "x", None), (2, 2, "override", "x", 25), (2, 3, "approve", "y", None), (2, 4, "override", "z", 10), (2, 5, "reset", "z", None),
    ], "plan_id int, seq int, kind string, id string, quantity int")
    got = sorted(tuple(r) for r in recommend.planner_state(log).collect())
    assert got == [(1, "a", 75, False), (1, "d", None, True), (2, "x", 25, False), (2, "y", None, True)]


def test_appearance_rules():
    """Trousers are judged by their region; a palette by the garment, not by the white around it."""
    composed = np.full((240, 160, 3), (35, 60, 210), dtype=np.uint8)
    composed[:70] = (210, 35, 35)
    blue = np.full((240, 160, 3), (35, 60, 210), dtype=np.uint8)
    look = lambda rgb, kind: images.palette(images.body_pixels(rgb, kind)).reshape(4, 4)
    assert np.allclose(look(composed, " ottr "), look(blue, "OTTR"), atol=0.5)
    assert abs(look(composed, "OTSH")[0] - look(blue, "OTTR")[0]).max() > 50
    framed = np.full((160, 120, 3), 255, dtype=np.uint8)
    framed[30:130, 25:95] = (210, 35, 35)
    red = look(framed, None)
    assert red[0, 3] > 0.99 and np.allclose(red[0, :3], images.lab_of(np.array([[210, 35, 35]]))[0], atol=0.1)
    assert images.region(np.zeros((100, 100, 3)), "OTTR").shape[:2] == (52, 68) and images.region(np.zeros((2, 2, 3)), "OTTR").shape[:2] == (1, 2)
    many = np.arange(3 * 11_999).reshape(-1, 3) % 256
    assert abs(images.palette(many)[3::4].sum() - 1) < 1e-6 and images.palette(np.zeros((0, 3))).tolist() == [0.0] * 16
    t = images.texture(np.tile(np.array([0, 0, 255, 255], dtype=np.uint8)[None, :, None], (64, 16, 3)))
    assert len(t) == 16 and abs(np.linalg.norm(t) - 1) < 1e-6 and t[:8].argmax() == 0
    assert images.working(np.zeros((1000, 500, 3), dtype=np.uint8)).shape == (images.WORKING_SIDE, images.WORKING_SIDE // 2, 3)


def test_legacy_files_are_taken_whole_or_not_at_all(spark, tmp_path):
    good = "OTSU51021001F2PC,OTSU,5102,1001,PLAINS,NAVY,100% Cotton,TAILORED,PRO,999\n"
    read = lambda text: catalogues.read_catalogue(spark, str(tmp_path / f"{abs(hash(text))}.csv"), historical=False)
    for text, why in ((good.replace("TAILORED", "NONSENSE"), "unknown"), (good.replace("TAILORED", "FORMAL"), "canonical already"), (good.replace("OTSU51021001F2PC", "??"), "no identifier"), ("", "no rows"), (",,,,,,,,,\n", "blank rows only")):
        full = LEGACY + (good if why not in ("no rows", "blank rows only") else "") + text
        (tmp_path / f"{abs(hash(full))}.csv").write_text(full)
        with pytest.raises(validate.CatalogueError, match="product_id: not there"):
            read(full)
    full = LEGACY + good + ",,,,,,,,,\n" + good.replace("TAILORED", " relaxed wash ")
    (tmp_path / f"{abs(hash(full))}.csv").write_text(full)
    assert [(r["ordinal"], r["category_type"]) for r in read(full).orderBy("ordinal").collect()] == [(0, "FORMAL"), (1, "CASUAL")]
    assert catalogues.dedupe_names(["A", "B", "A", "A"]) == ["A", "B", "A__2", "A__3"]
