"""Streams give what the same rows give in one batch, whatever the micro-batches."""

import random

from pyspark.sql import functions as F

from loomplan.operators import demand, recommend, similarity
from loomplan.plans import queries
from loomplan.plans.matching import Matching
from loomplan.sources.stage import settle
from loomplan.streaming import arrivals, planner

LOG = "plan_id long, seq long, kind string, id string, quantity long"


def test_arrivals_equal_the_batch_also_after_a_replay(spark, sf, tmp_path):
    m = Matching(spark, sf)
    right, left = settle(m.right.select("id", "ordinal", "vector"), "right"), settle(m.left.select("id", "ordinal", "vector"), "left")
    _, median, scale = similarity.all_pairs_calibration(left, right)
    path = str(tmp_path / "build")
    arrivals.save_build(arrivals.Build(right, demand.fit_demand(m.history), median, scale), path)
    build = arrivals.load_build(spark, path)
    upcoming = settle(m.upcoming, "upcoming")
    one = lambda df: {r["id"]: (r["best_id"], r["quantity"], r["expected_sales"]) for r in df.select("id", "best_id", "quantity", "expected_sales").collect()}
    whole = one(build.recommended(upcoming.join(left.select("id", "vector"), "id", "left")))

    at = F.timestamp_seconds(F.lit(1_750_000_000) + F.pmod(F.xxhash64("id"), F.lit(3_000)))
    products, pictures = upcoming.withColumn("arrived", at), left.select("id", "vector").withColumn("seen", at)
    folders = [str(tmp_path / x) for x in ("products", "pictures", "out", "state")]
    stream = lambda i, schema: spark.readStream.schema(schema).parquet(folders[i])

    def run():
        arrivals.serve(stream(0, products.schema), stream(1, pictures.schema), build, folders[2], folders[3], late="2 hours").awaitTermination()

    early, late = "ordinal % 3 = 0", "ordinal % 3 <> 0"
    products.where(early).write.mode("append").parquet(folders[0])
    # Half of the pictures come later than their products, which wait; a product comes twice.
    pictures.where("pmod(xxhash64(id), 2) = 0").write.mode("append").parquet(folders[1])
    run()
    first = one(arrivals.served(spark, folders[2]))
    waiting = {r["id"] for r in upcoming.where(f"{early} and has_image and pmod(xxhash64(id), 2) = 1").collect()}
    assert first and waiting and not waiting & set(first) and first.items() <= whole.items()

    products.where(late).union(products.where(early).limit(3)).write.mode("append").parquet(folders[0])
    pictures.where("pmod(xxhash64(id), 2) = 1").write.mode("append").parquet(folders[1])
    run()
    assert one(arrivals.served(spark, folders[2])) == whole

    # The last batch was written but not committed: it runs again, over its own files.
    last = max((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    rows = spark.read.parquet(folders[2]).count()
    run()
    assert one(arrivals.served(spark, folders[2])) == whole and spark.read.parquet(folders[2]).count() == rows


def test_plans_from_any_micro_batches(spark, tmp_path):
    rng = random.Random(6)
    kinds = ["override", "override", "approve", "approve", "choose", "reset", "settings", "other"]
    log = []
    for plan in range(6):
        for seq in range(60):
            kind = "settings" if rng.random() < 0.03 else rng.choice(kinds[:6] + kinds[7:])
            log.append((plan, seq, kind, None if kind == "settings" else rng.choice(["a", "b", "c", "d", None]), rng.randrange(100) if rng.random() < 0.9 else None))
    expected = sorted(map(tuple, recommend.planner_state(spark.createDataFrame(log, LOG)).collect()), key=repr)
    events = log + rng.sample(log, 80)
    rng.shuffle(events)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cuts = sorted(rng.sample(range(len(events)), 3))
    for a, b in zip([0, *cuts], [*cuts, len(events)]):
        spark.createDataFrame(events[a:b], LOG).coalesce(1).write.mode("append").parquet(source)
        planner.follow_plans(spark.readStream.schema(LOG).parquet(source), out, state).awaitTermination()
    assert sorted(map(tuple, planner.plans(spark, out).collect()), key=repr) == expected


def test_a_cleared_plan_costs_one_row_of_state(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(1, i, "override", f"p{i}", i) for i in range(200)] + [(2, 0, "override", "a", 7), (2, 1, "approve", "a", None)]
    # An override from before the plan was cleared comes after that, and changes nothing.
    rounds = [first, [(1, 300, "settings", None, None)], [(1, 299, "override", "p3", 5), (1, 301, "approve", "p4", None)]]
    for rows in rounds:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        planner.follow_plans(spark.readStream.schema(LOG).parquet(source), out, state).awaitTermination()
    changed = {r["batch_id"]: r["n"] for r in spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert changed == {0: 201, 1: 1, 2: 2}
    assert sorted(map(tuple, planner.plans(spark, out).collect())) == [(1, "p4", None, True), (2, "a", 7, True)]
    assert planner.plans(spark, out).dtypes == recommend.planner_state(spark.createDataFrame(first, LOG)).dtypes


def test_a_micro_batch_of_a_table_has_many_files(spark, tmp_path):
    seen = {}

    def note(batch, n):
        rows = batch.select("seq", F.input_file_name().alias("file")).collect()
        seen[n] = ({r["seq"] for r in rows}, {r["file"] for r in rows})

    rows = spark.range(2_000).select(F.pmod("id", F.lit(7)).alias("plan_id"), F.col("id").alias("seq"))
    stream = queries._read_as_stream(rows, "dealt", 3)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(note).start().awaitTermination()
    assert len(seen) == 3 and set.union(*(s for s, _ in seen.values())) == set(range(2_000))
    # Four shuffle partitions in tests.
    assert all(len(files) == 2 and max(s) - min(s) > 1_000 for s, files in seen.values())
