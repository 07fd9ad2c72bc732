"""Manifests of articles, books and videos, and the sinks beside them. Paths are whatever Spark's readers know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.functions.urls import clean, route

MANIFEST = "id string, title string, url string, resource_code string, description string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("id", "title", "url")) -> DataFrame:
    """Rows of a JSON array file, trimmed. A row that misses a required field fails the read. No file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True)
    rows = rows.select(*(F.trim(c).alias(c) for c in rows.columns))
    for c in required:
        rows = rows.withColumn(c, F.when(text(c) == "", F.raise_error(F.lit(f"{c} is required"))).otherwise(F.col(c)))
    return rows


def only_ids(rows: DataFrame, ids: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows of a comma-separated list of ids, the ids that no row has); all rows where ids is None."""
    spark = rows.sparkSession
    if ids is None:
        return rows, spark.createDataFrame([], "id string")
    wanted = spark.range(1).select(F.explode(F.filter(F.transform(F.split(F.lit(ids), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("id")).distinct()
    return rows.join(wanted, "id", "left_semi"), wanted.join(rows, "id", "left_anti")


def union_sources(**groups: DataFrame) -> DataFrame:
    """All manifests, each row with its type."""
    out = None
    for kind, rows in groups.items():
        one = rows.select(F.lit(kind).alias("type"), *rows.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def export_links(rows: DataFrame) -> DataFrame:
    """Self-study rows of a workbook (row_number, Type, Title, URL, Code, Description) by kind: book, video or article.

    Rows with neither URL nor code are left out; a blank URL is blank.
    """
    kept = rows.where((F.trim(text("Type")) == "Self-study") & ((F.trim(text("URL")) != "") | (F.trim(text("Code")) != "")))
    return kept.select(
        F.col("row_number").cast("string").alias("id"), F.trim(text("Title")).alias("title"), clean("URL").alias("url"), F.trim(text("Code")).alias("resource_code"),
        F.trim(text("Description")).alias("description"), route("URL", F.col("Title"), F.col("Code")).alias("kind"),
    )


def write_sorted_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line, keys sorted at the top level."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def first_candidate(rows: DataFrame, key: str, rank: Column | str) -> DataFrame:
    """One row a key: that of the smallest rank, as a cache that is asked for several keys in turn."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("_r")).select(key, "_r.*")


def artifact_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, text) of files named 'id-title.md' under a folder, the first by name for each id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(F.regexp_extract(name, r"^(\d+)-", 1).alias("id"), "path", F.decode("content", "UTF-8").alias("text")).where("id <> ''")
    return found.groupBy("id").agg(F.min(F.struct("path", "text")).alias("_f")).select("id", "_f.*")
