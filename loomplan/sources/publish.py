"""Published results: versions, exports, saved features and their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomplan.functions.text import safe_cell
from loomplan.sources.commits import commit, entries


def cache_key(*parts: Column) -> Column:
    """What a feature depends on: checksum, item type, models, revisions, preprocessing."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted rows whose cache_key isn't in the cache."""
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def pruned(cache: DataFrame, *references: DataFrame) -> DataFrame:
    """Cache rows that any of the references still uses."""
    used = references[0].select("cache_key")
    for r in references[1:]:
        used = used.union(r.select("cache_key"))
    return cache.join(used.distinct(), "cache_key", "left_semi")


def save_features(features: DataFrame, path: str, model_key: str) -> None:
    """Save the features of one model in place of its earlier ones; those of other models stay."""
    rows = features.withColumn("model_key", F.lit(model_key))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_key").parquet(path)


def load_features(spark: SparkSession, path: str, model_key: str) -> DataFrame:
    """Saved features of one model; only its partition is read.  Another model's are refused."""
    found = spark.read.parquet(path).where(F.col("model_key") == model_key)
    if found.isEmpty():
        raise ValueError(f"no features saved for model {model_key}")
    return found.drop("model_key")


BUILDS = "number long, build_id string, created string, tables array<string>, historical_build string, removed boolean"


class Conflict(ValueError):
    """A build can't be committed as things stand now."""


def _standing(before: list[tuple[int, dict]]) -> dict[str, dict]:
    """Builds by id, in the order of their commits, as the log's entries leave them."""
    out: dict[str, dict] = {}
    for number, e in before:
        if "build_id" in e:
            out[e["build_id"]] = e | {"number": number, "removed": False}
        for gone in e.get("removed", []):
            out[gone]["removed"] = True
    return out


def builds(spark: SparkSession, root: str) -> DataFrame:
    """Every build ever committed: number, build_id, created, tables, historical_build and whether its files are removed."""
    names = [c.split(" ")[0] for c in BUILDS.split(", ")]
    return spark.createDataFrame([tuple(e.get(c) for c in names) for e in _standing(entries(spark, root)).values()], BUILDS)


def publish(tables: dict[str, DataFrame], root: str, build_id: str, created: str, *, historical_build: str | None = None, replaces: str | None = None) -> int:
    """Write a build, check that its tables can be read and hold rows, then commit it; returns its number.

    The committed build of the highest number is the active one, so a failure before the
    commit leaves the active one as it was, and of two that publish at once both are
    whole and the later commit is active.  What a build relies on is looked at again in
    each try to commit: ``historical_build``, the build whose history it reuses, must still
    be there, and with ``replaces`` that build must still be the active one; otherwise
    ``Conflict``.  A build_id can be committed once.
    """
    spark = next(iter(tables.values())).sparkSession

    def entry(before: list[tuple[int, dict]]) -> dict:
        known = _standing(before)
        if build_id in known:
            raise Conflict(f"build {build_id} is there already")
        if historical_build is not None and (historical_build not in known or known[historical_build]["removed"]):
            raise Conflict(f"the history of build {historical_build} isn't there")
        if replaces is not None and (not known or list(known)[-1] != replaces):
            raise Conflict(f"build {replaces} isn't the active one")
        return {"build_id": build_id, "created": created, "tables": sorted(tables), "historical_build": historical_build}

    entry(entries(spark, root))
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/build_id={build_id}/{name}")
    for name in tables:
        if spark.read.parquet(f"{root}/build_id={build_id}/{name}").isEmpty():
            raise ValueError(f"{name} has no rows; version {build_id} is not activated")
    return commit(spark, root, entry)[0]


def active_build(builds: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """The newest build (by created, build_id), with its versions where given."""
    newest = builds.agg(F.max(F.struct("created", "build_id")).alias("b")).select(F.col("b.build_id").alias("build_id"))
    out = builds.join(newest, "build_id", "left_semi")
    return out if versions is None else out.join(versions, "build_id")


def active_versions(pointer: DataFrame, builds: DataFrame, historical: DataFrame, upcoming: DataFrame) -> DataFrame:
    """The build that ``pointer`` (build_id) names, with its versions of both catalogues.

    builds: build_id, historical_version, upcoming_version and more; historical, upcoming:
    version and more, prefixed in the result.  A build whose version isn't there gives no row.
    """
    out = builds.join(pointer.select("build_id"), "build_id", "left_semi")
    for side, versions in (("historical", historical), ("upcoming", upcoming)):
        own = versions.select(*[F.col(c).alias(f"{side}_{c}") for c in versions.columns])
        out = out.join(own, f"{side}_version")
    return out


def load_active(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the active build."""
    known = _standing(entries(spark, root))
    if not known:
        raise ValueError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/build_id={list(known)[-1]}/{table}")


def superseded(builds: DataFrame, keep: int = 1) -> DataFrame:
    """(build_id) of the builds behind the ``keep`` newest whose history no kept build reuses.

    builds: build_id, created, and historical_build (the build whose history it reads, null
    for its own).  Rows are one for each build, so few.
    """
    order = Window.orderBy(F.desc("created"), F.desc("build_id"))
    ranked = builds.withColumn("_n", F.row_number().over(order))
    kept = ranked.where(F.col("_n") <= keep).select(F.explode(F.array("build_id", F.coalesce("historical_build", "build_id"))).alias("build_id"))
    return ranked.where(F.col("_n") > keep).select("build_id").join(kept, "build_id", "left_anti")


def remove_superseded(spark: SparkSession, root: str, *, keep: int = 1) -> list[str]:
    """Delete the files of builds behind the ``keep`` last whose history none of these reuses, and return their ids.

    The removal is committed before anything is deleted, so a publisher that would reuse
    such a history comes before it, and the history stays, or after it and is refused.
    """

    def entry(before: list[tuple[int, dict]]) -> dict:
        known = list(_standing(before).values())
        kept = known[-keep:] if keep else []
        used = {e["build_id"] for e in kept} | {e["historical_build"] for e in kept}
        return {"removed": sorted(e["build_id"] for e in known if e["build_id"] not in used and not e["removed"])}

    if not entry(entries(spark, root))["removed"]:
        return []
    gone = commit(spark, root, entry)[1]["removed"]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for build in gone:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/build_id={build}")
        path.getFileSystem(conf).delete(path, True)
    return gone


#: Rows of a page at most.
MOST_PAGE = 500


def write_pages(results: DataFrame, path: str, order: str = "ordinal", *, files: int | None = None) -> None:
    """Lay results out for paging: each file holds a range of ``order``, and an index says which.

    ``order`` must be whole numbers; rows without one can't be paged and are an error.
    """
    spark = results.sparkSession
    if not results.where(F.col(order).isNull()).isEmpty():
        raise ValueError(f"rows without {order} have no page")
    dealt = results.repartitionByRange(files, order) if files else results.repartitionByRange(order)
    dealt.sortWithinPartitions(order).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file"))
    rows.agg(F.min(order).cast("long").alias("low"), F.max(order).cast("long").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, cursor: int | None, limit: int = 100, order: str = "ordinal") -> DataFrame:
    """Rows after ``cursor`` (null: from the start) in order, at most 1 to 500 of them, each with ``next_cursor``.

    ``next_cursor``: what to ask for the following page, null on the last one.  The index
    gives the range that holds the page, so the scan has both ends of it and skips all
    other files; the page is the top of that range, without a sort of all rows.  Rows that
    share a place are not torn apart: they all come on the page that reaches it.
    """
    size = min(MOST_PAGE, max(1, limit))
    after = F.lit(True) if cursor is None else F.col(order) > cursor
    # Each file has a row at least, so a page and the row after it lie in so many.
    spans = spark.read.parquet(f"{path}/index").where("true" if cursor is None else f"high > {int(cursor)}").orderBy("low").limit(size + 2).collect()
    high, held = None, 0
    for s in spans:
        high = s["high"]
        held += s["n"] if cursor is None or s["low"] > cursor else 0
        if held > size:
            break
    rows = spark.read.parquet(f"{path}/rows").where(after & (F.lit(False) if high is None else F.col(order) <= high))
    last = rows.orderBy(order).limit(size).agg(F.max(order)).first()[0]
    page = rows.where(F.col(order) <= F.lit(last)) if last is not None else rows.limit(0)
    whole = last is None or (not spans or last >= max(s["high"] for s in spans))
    return page.withColumn("next_cursor", F.lit(None if whole else last).cast("long"))


def export_rows(results: DataFrame) -> DataFrame:
    """Six text columns for a spreadsheet, the first published match for each product."""
    best = F.try_element_at("matches", F.lit(1))
    columns = {"product_id": F.col("id"), "item_type": F.col("item_type"), "match_confidence": F.col("match_confidence"), "expected_sales": F.col("expected_sales"), "quantity": F.col("quantity"), "best_match": best["historical_id"]}
    return results.select(*[F.coalesce(safe_cell(c), F.lit("")).alias(n) for n, c in columns.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
