"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import run_dir

_SHIPPED = "FEEDLOOM_SHIPPED"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


# Spark deletes the shuffle files of a query when it ends, instead of when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` below the shared folder and reads it back, which cuts its lineage.

    Nothing needs its shuffle files after that, so they go at once.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*staged: DataFrame) -> None:
    """Deletes the tables of `stage` that nothing will read again: all that came of them has been written."""
    for df in staged:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that every engine gets the same letters."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """Tells rows apart whose ids are null or repeated; never null."""
    return F.xxhash64(text)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores behind it until no column of `docs` has the name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def joined_by_row(docs: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """`docs` joined to the rows of `keyed` (doc_id, text_key, ...) by id and text; a null id equals another one.

    Columns of `keyed` but the two must have names that `docs` hasn't.
    """
    name, key = free_names(docs, "row_id", "row_key")
    others = [c for c in keyed.columns if c not in ("doc_id", "text_key")]
    right = keyed.select(F.col("doc_id").alias(name), F.col("text_key").alias(key), *others)
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (text_key(F.col("text")) == F.col(key))
    joined = docs.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(name, key)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of `docs` whose (doc_id, text) isn't in `bad` (doc_id, text_key)."""
    return joined_by_row(docs, bad.select("doc_id", "text_key").distinct(), "left_anti")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    digits = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(digits.cast("binary")), F.lit(parts))


# Texts come to Python workers in batches of so many bytes at most; a task holds several copies of one. A session that
# sets a limit of its own keeps it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT, USUAL_LIMIT = "8m", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for Python workers, wherever they run, and bounds what they are sent at once."""
    if spark.conf.get(BATCH_BYTES) == USUAL_LIMIT:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)
    if _SHIPPED in spark.sparkContext.environment:
        return
    package = Path(__file__).resolve().parents[1]
    target = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="feedloom-py-"), package.name),
        "zip",
        package.parent,
        package.name,
    )
    spark.sparkContext.addPyFile(target)
    spark.sparkContext.environment[_SHIPPED] = "1"
