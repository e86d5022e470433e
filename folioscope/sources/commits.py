"""Sets of tables that change together: numbered commits, readers of one version, writers that notice each other.

A version is a file that names where each of its tables lies.  Its number is taken by creating the file where none is: of two writers one gets it, and the other reads what is new
and tries the next number, unless it asked to follow the version that it has read.  Tables are written before the commit under names of their own; what no commit names can be
removed later.  A reader opens the newest version, or an older one, and nothing that a writer does changes it.

Taking a number relies on a create that fails where a file is, in one step (HDFS's, the platform's for local paths); a store without it needs another way to do that.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Superseded(RuntimeError):
    """Another writer has committed since the version that this one wanted to follow."""


def _files(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _number(version: int) -> str:
    return f"{version:012d}.json"


def _taken(spark: SparkSession, root: str) -> dict[int, bool]:
    """The numbers that writers have, and whether their files are written."""
    files, path = _files(spark, f"{root}/_commits")
    found = files.listStatus(path) if files.exists(path) else []
    return {int(s.getPath().getName().removesuffix(".json")): s.getLen() > 0 for s in found if s.getPath().getName().endswith(".json")}


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(v for v, done in _taken(spark, root).items() if done)


def _take(spark: SparkSession, root: str, version: int, content: bytes) -> bool:
    """Whether this writer got the number."""
    files, path = _files(spark, f"{root}/_commits/{_number(version)}")
    local = files.getUri().getScheme() == "file"
    if local:
        # Hadoop's local file system looks first and creates then; the platform does both in one step.
        files.mkdirs(path.getParent())
        if not spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile():
            return False
    try:
        out = files.create(path, local)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


def commit(tables: dict[str, DataFrame], root: str, follows: int | None = None, tries: int = 20) -> int:
    """Writes the tables and publishes them as the next version, whose number is returned.

    With ``follows`` (0: none yet) the commit is refused if another version has come since; without, tables that others published meanwhile and this commit doesn't name stay as they are.
    """
    spark = next(iter(tables.values())).sparkSession
    written = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{written[name]}")
    for _ in range(tries):
        now = _taken(spark, root)
        last = max(now, default=0)
        if last and not now[last]:
            time.sleep(0.2)  # a writer has the number and is about to write
            continue
        if follows is not None and last != follows:
            raise Superseded(f"version {last} has come since version {follows}")
        named = (read(spark, root, last) if last else {}) | written
        if _take(spark, root, last + 1, json.dumps({"tables": named, "wrote": sorted(written)}).encode()):
            return last + 1
    raise Superseded(f"no number after {tries} tries; an empty file at the end of _commits is a writer that died and can be removed")


def read(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    """Where each table of a version lies."""
    text = spark.read.text(f"{root}/_commits/{_number(version)}", wholetext=True).first()[0]
    return json.loads(text)["tables"]


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is named."""
    if version is None:
        now = versions(spark, root)
        if not now:
            raise FileNotFoundError(f"nothing is published under {root}")
        version = now[-1]
    return {name: spark.read.parquet(f"{root}/{where}") for name, where in read(spark, root, version).items()}


def unnamed(spark: SparkSession, root: str) -> list[str]:
    """Tables under ``root`` that no version names: writes that were refused, or are still going on."""
    files, path = _files(spark, root)
    known = {where for v in versions(spark, root) for where in read(spark, root, v).values()}
    found = [f"{d.getPath().getName()}/{t.getPath().getName()}" for d in files.listStatus(path) if d.isDirectory() and not d.getPath().getName().startswith("_") for t in files.listStatus(d.getPath())]
    return sorted(x for x in found if x not in known)


def index_tables(documents: DataFrame, sections: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """docs, sections, links and orphans as they are published: of documents with the same type and id only the first writer's stays, with its sections and different links.

    ``documents``: doc_type, doc_id, writer (the order), ...; ``sections`` and ``links`` (to_type, to_id) name their document by doc_type, doc_id and writer.  Orphans are notes that no concept or overview links to.
    """
    key = ["doc_type", "doc_id"]
    docs = documents.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("writer"))).where("nth = 1").drop("nth")
    won = docs.select(*key, "writer")
    own = sections.join(won, [*key, "writer"], "left_semi")
    edges = links.join(won, [*key, "writer"], "left_semi").select(F.col("doc_type").alias("from_type"), F.col("doc_id").alias("from_id"), "to_type", "to_id").distinct()
    linked = edges.where("to_type = 'note' and from_type in ('concept', 'overview')").select(F.col("to_id").alias("doc_id")).distinct()
    return {"docs": docs, "sections": own, "links": edges, "orphans": docs.where("doc_type = 'note'").select("doc_id").join(linked, "doc_id", "left_anti")}
