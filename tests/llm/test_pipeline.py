"""The pipeline on the smallest tables, held against each stage's rule."""

import random

import corpus_pipeline
from loomplan.llm.decontaminate import contained_items
from loomplan.llm.jaccard_join import jaccard_classes
from loomplan.llm.line_dedup import line_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows, kept = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        kept.append(docs.count())
    assert rows >= kept[0] >= kept[1] >= kept[2] >= kept[3] > 0
    assert jaccard_classes(docs).where("doc_id <> class_id").count() == 0
    assert contained_items(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert line_dedup(docs).where("n_dropped > 0").count() == 0
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept[3]


def test_stage_edges(spark, sf):
    """Null, empty and repeated rows, and none: what each stage by itself keeps."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (2, "", "en", "src0", 0), (None, "some words here", "en", "src0", 15)]
    docs = spark.createDataFrame(rows, schema)
    kept = lambda stage: sorted(map(tuple, stage(spark, docs, sf).collect()), key=str)
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_contaminated):
        assert kept(stage) == sorted(rows, key=str)
    # The three texts of no words are one class.
    assert kept(corpus_pipeline.one_of_each_class) == sorted([rows[0], rows[3]], key=str)
    # Equal texts share a verdict.
    scored = {(r[0], r[1]) for r in kept(corpus_pipeline.keep_quality)}
    assert ((1, None) in scored) == ((2, "") in scored)
    assert corpus_pipeline.pack(spark, docs, sf).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0


def test_rows_of_one_id_and_rows_without(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rng = random.Random(1)
    clean, other = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(2))
    row = lambda i, t: (i, t, "en", "src0", len(t))
    rows = [row(5, clean), row(5, clean), row(None, clean + " more"), row(5, other), row(None, item), row(5, item), row(None, other + " and " + item)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, corpus_pipeline.one_of_each_class(spark, docs, sf).collect()), key=str)
    assert got == sorted([row(5, clean), row(5, other), row(5, item), rows[6]], key=str)
    # A clean text stays though its id has contaminated ones.
    got = sorted(map(tuple, corpus_pipeline.drop_contaminated(spark, docs, sf).collect()), key=str)
    assert got == sorted(rows[:4], key=str)
