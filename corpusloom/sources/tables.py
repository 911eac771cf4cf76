"""Readers and the adapter from plain tables to the logical documents of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (first line, 80 characters), content, language, collection, n_chars."""
    d = table(spark, sf_dir, "documents")
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80)
    return d.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("collection"), "n_chars")


#: The same adapter for the SQL oracles.
SQL = "WITH d AS (SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, lang AS language, source AS collection, n_chars FROM documents)"


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all columns of the logical schema; those that the plain table lacks are made up from the id."""
    return table(spark, sf_dir, "documents").selectExpr(*SHELF_COLUMNS)


#: Made-up columns, in expressions that Spark and DuckDB read alike.
SHELF_COLUMNS = (
    "doc_id AS id", "text AS content", "source AS name", "CASE WHEN doc_id % 5 = 0 THEN 'note' WHEN doc_id % 5 = 1 THEN 'pdf' ELSE 'book' END AS type",
    "CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' ELSE 'txt' END AS format", "concat('title ', CAST(doc_id % 97 AS string)) AS title",
    "CASE doc_id % 7 WHEN 0 THEN 'en-US' WHEN 1 THEN ' ENG' WHEN 2 THEN 'zh-Hant' WHEN 3 THEN 'pt-BR' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE lang END AS language",
    "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS collection", "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('author ', CAST(doc_id % 17 AS string)) END AS author",
    "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('covers/', CAST(doc_id AS string)) END AS cover_path", "doc_id % 4 <> 0 AND doc_id % 9 <> 0 AS cover_exists",
    "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('files/', CAST(doc_id AS string)) END AS file_path", "doc_id % 13 <> 0 AND doc_id % 8 <> 0 AS file_exists",
    "n_chars * 3 % 1000 AS file_size", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 11) / 10.0 END AS progress", "doc_id * 37 AS created_minute",
    "doc_id * 37 + doc_id % 10 * 1440 AS updated_minute", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 37 + doc_id % 50 * 60 END AS read_minute",
    "doc_id % 10 = 3 AS deleted", "CASE WHEN doc_id % 6 = 2 THEN NULL ELSE doc_id * 37 + 7200 END AS checked_minute",
)
SHELF_SQL = "WITH s AS (SELECT " + ", ".join(SHELF_COLUMNS) + " FROM documents)"


def tags(df: DataFrame) -> DataFrame:
    """id, tag: a made-up bridge of one or two tags a row, and one row twice, as a fan-out join would give it."""
    both = F.array(F.concat(F.lit("t"), F.col("id") % 5), F.concat(F.lit("t"), F.col("id") * 7 % 9), F.concat(F.lit("t"), F.col("id") % 5))
    return df.select("id", F.explode(both).alias("tag"))


#: The same bridge for the SQL oracles, after SHELF_SQL.
TAGS_SQL = ", b AS (SELECT id, concat('t', id % 5) AS tag FROM s UNION ALL SELECT id, concat('t', id * 7 % 9) FROM s UNION ALL SELECT id, concat('t', id % 5) FROM s)"


def files(spark: SparkSession, path: str, pattern: str = "*", empty_sizes: tuple[int, ...] = (0, 143), formats: tuple[str, ...] = ("pdf", "epub", "txt", "md", "html", "mobi", "azw3")) -> DataFrame:
    """Listing of a directory tree: path, name, size, mtime and a kind: importable, bad, unsupported or duplicate.

    Only metadata are read (the content column is pruned). Of several files of one name and size the first by path
    counts, the others are duplicates. Spark's file reader leaves files of 0 bytes out of the listing.
    """
    from pyspark.sql import Window

    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    nth = F.row_number().over(Window.partitionBy("name", "size").orderBy("path"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.when(F.col("size").isin(*empty_sizes), "bad").when(~suffix.isin(*formats), "unsupported").when(nth > 1, "duplicate").otherwise("importable")
    return rows.withColumn("kind", kind)



def decoded(content):
    """Text of a binary column: UTF-8 where valid, else Latin-1 (the session has no other decoder that tells failure)."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(plain, F.decode(content, "ISO-8859-1"))
