"""A log of numbered entries, each written whole by exactly one writer.

Writers agree without a lock: entry n is put only if there is none, and a writer that
comes second looks at what was put and tries n + 1.  Readers list the entries; what no
entry names isn't there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

DIGITS = 20


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet, whole or not at all; False if another stands there.

    A local file is written under a name of its own and linked to its place, which fails if
    that is taken.  Elsewhere it is created without overwriting, which distributed file
    systems decide in one place.
    """
    jvm, files = spark.sparkContext._jvm, _files(spark, path)
    local = files.getScheme() == "file"
    target = _path(spark, path)
    if not local and files.exists(target):
        return False
    files.mkdirs(target.getParent())
    own = _path(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}") if local else target
    try:
        out = files.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        if local:
            paths = [jvm.java.nio.file.Path.of(p.toUri()) if p.toUri().getScheme() else jvm.java.io.File(p.toString()).toPath() for p in (target, own)]
            jvm.java.nio.file.Files.createLink(*paths)
        return True
    except Exception as e:  # py4j wraps what Java throws
        if "AlreadyExists" in str(e):
            return False
        raise
    finally:
        if local:
            files.delete(own, False)


def entries(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    """(number, entry) of every entry in order; few, one for each version."""
    folder = f"{root}/_log"
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(_path(spark, folder)))
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        if name.endswith(".json") and not name.startswith("."):
            stream = files.open(_path(spark, f"{folder}/{name}"))
            try:
                out.append((int(name[:DIGITS]), json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            finally:
                stream.close()
    return out


def commit(spark: SparkSession, root: str, entry: Callable[[list[tuple[int, dict]]], dict], tries: int = 100) -> tuple[int, dict]:
    """Add what ``entry`` makes of the entries so far; it is asked anew after each lost race, and may refuse by raising."""
    for _ in range(tries):
        before = entries(spark, root)
        number, new = (before[-1][0] + 1 if before else 1), entry(before)
        if put_if_absent(spark, f"{root}/_log/{number:0{DIGITS}d}.json", json.dumps(new, sort_keys=True)):
            return number, new
    raise RuntimeError(f"{tries} other writers came first")
