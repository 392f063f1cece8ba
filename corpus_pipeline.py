"""A training corpus from ``documents``: five stages, each on all that the last one kept.

Every stage judges rows, not ids: rows that share an id with other texts are rows by
themselves, and rows without an id are treated as any other.  Null and empty texts
are texts of no words; very long ones are read whole.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import cut, table
from loomplan.llm.decontaminate import without_items
from loomplan.llm.jaccard_join import jaccard_classes
from loomplan.llm.line_dedup import line_dedup
from loomplan.llm.packing import best_fit_packing
from loomplan.llm.quality_gam import quality_scores, train


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, accepts.

    Null and empty texts are scored as any other.  Repeated rows score alike, so all
    of them stay or go.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across them; those left without text by that go.

    A text without such lines stays as it is, a null one null.  Rows of one id count as
    one document; rows without an id are no document and keep no repeated line.
    """
    out = line_dedup(docs).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).where("n_dropped = 0 or trim(text) <> ''").select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of least id, of least hash of the text among equal ids.

    Documents without an id come after all others.  Of rows that are equal in id and text
    one stays, any of them.  Null, empty and blank texts are one class.
    """
    classes = jaccard_classes(docs)
    marks = classes.groupBy("doc_id", "text_key").agg(F.max("is_first").alias("stays"), F.count("*").alias("n"))
    marks = cut(marks.where("not stays or n > 1"), "not-all-stay").withColumnRenamed("doc_id", "_id")
    rows = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (rows["text_key"] == marks["text_key"])
    single = rows.join(marks, same, "left_anti").select(*docs.columns)
    once = rows.join(marks.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*docs.columns)
    return single.unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, packed into sequences of 2048 tokens; repeated rows as often as they stand there."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
