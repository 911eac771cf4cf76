"""Queries over the client's own books, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports, local, reports
from ..sources.tables import SHELF_SQL, TAGS_SQL, shelf, table, tags
from .base import query

#: Books of a client, made up from the shelf in expressions that Spark and DuckDB read alike.
BOOKS = (
    "id", "title", "author", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('Press ', id % 4) END AS publisher", "substr(content, 1, 200) AS description", "collection AS category",
    "upper(format) AS format", "language", "id % 13 * 10.0 AS progress", "created_minute AS added_at", "read_minute AS last_read_at", "file_size",
)
BOOKS_SQL = SHELF_SQL + ", k AS (SELECT " + ", ".join(BOOKS) + " FROM s)"


def books(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).selectExpr(*BOOKS).withColumn("tags", F.array(F.concat(F.lit("t"), F.col("id") % 5)))


@query("f_local_filter", BOOKS_SQL + """ SELECT id, format FROM k WHERE contains(lower(concat(coalesce(title, ''), ' ', coalesce(author, ''), ' ', coalesce(publisher, ''), ' ', description)), 'press 1')
AND contains(coalesce(author, ''), 'author 1') AND format = 'TXT' AND id % 5 = 2 AND progress > 0 AND progress < 100""")
def f_local_filter(spark: SparkSession, sf: str) -> DataFrame:
    return local.matches(books(spark, sf), search=" PRESS 1 ", author="author 1", format="txt", tag="t2", shelf="reading").select("id", "format")


def _sorted(name: str, order: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return local.sort(books(spark, sf), name, 40, 10).select("id", "title")

    query(f"o_local_{name}", BOOKS_SQL + f" SELECT id, title FROM k ORDER BY {order}, id LIMIT 40 OFFSET 10")(run)


for _name, _order in {"author_asc": "coalesce(author, ''), title", "last_read_desc": "last_read_at DESC NULLS LAST", "progress_desc": "progress DESC"}.items():
    _sorted(_name, _order)


@query("r_local_stats", BOOKS_SQL + """, e AS (SELECT o_orderdate AS d, o_orderkey % 90 AS m FROM orders)
SELECT 'books' AS dimension, '' AS value, CAST(count(*) AS DOUBLE) AS n FROM k UNION ALL SELECT 'started', '', count(*) FILTER (progress > 0) FROM k UNION ALL SELECT 'completed', '', count(*) FILTER (progress >= 100) FROM k
UNION ALL SELECT 'format', format, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'minutes', '', sum(m) FROM e UNION ALL SELECT 'day', CAST(CAST(d AS DATE) AS VARCHAR), sum(m) FROM e GROUP BY 2""")
def r_local_stats(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    records = table(spark, sf, "orders").select(at.alias("started_at"), F.timestamp_seconds(F.unix_seconds(at) + F.col("o_orderkey") % 90 * 60).alias("ended_at"))
    return local.stats(books(spark, sf), records)


@query("q_without_cover", SHELF_SQL + """, c AS (SELECT *, CASE WHEN id % 5 = 2 THEN '978' END AS isbn FROM s WHERE cover_path IS NULL), v AS (SELECT 'all' AS dimension, '' AS value, * FROM c UNION ALL SELECT 'format', format, * FROM c UNION ALL SELECT 'type', type, * FROM c)
SELECT dimension, value, count(*) AS rows, count(*) FILTER (NOT deleted) AS alive, count(*) FILTER (NOT deleted AND isbn IS NOT NULL) AS isbn, count(*) FILTER (NOT deleted AND trim(coalesce(author, '')) <> '') AS author FROM v GROUP BY dimension, value""")
def q_without_cover(spark: SparkSession, sf: str) -> DataFrame:
    return reports.without_cover(shelf(spark, sf).withColumn("isbn", F.when(F.col("id") % 5 == 2, "978")))


@query("q_without_content", SHELF_SQL + """, c AS (SELECT * FROM s WHERE id % 4 = 1 OR trim(coalesce(content, '')) = ''), v AS (SELECT 'all' AS dimension, '' AS value, * FROM c UNION ALL SELECT 'format', format, * FROM c)
SELECT dimension, value, count(*) AS rows, count(*) FILTER (NOT deleted) AS alive, count(*) FILTER (NOT deleted AND format IN ('epub', 'txt') AND file_path IS NOT NULL) AS target FROM v GROUP BY dimension, value""")
def q_without_content(spark: SparkSession, sf: str) -> DataFrame:
    return reports.without_content(shelf(spark, sf).withColumn("content", F.when(F.col("id") % 4 == 1, " ").otherwise(F.col("content"))), ("epub", "txt"))


@query("q_database_report", SHELF_SQL + """, c AS (SELECT id, type, format, deleted, file_path, file_exists, CASE WHEN id % 9 = 4 THEN '' ELSE content END AS content, CASE WHEN id % 3 = 0 THEN concat('x', id // 6) END AS sha256 FROM s), a AS (SELECT * FROM c WHERE NOT deleted)
SELECT 'total' AS "check", '' AS value, count(*) AS n, false AS problem FROM c UNION ALL SELECT 'deleted', '', count(*) FILTER (deleted), false FROM c UNION ALL SELECT 'type', type, count(*), false FROM c GROUP BY type
UNION ALL SELECT 'missing', file_path, 1, true FROM a WHERE file_path IS NOT NULL AND NOT file_exists
UNION ALL SELECT 'orphan_file', concat('files/', id), 1, true FROM c WHERE file_exists AND deleted
UNION ALL SELECT 'empty', concat(type, '/', format), count(*), type <> 'note' FROM a WHERE coalesce(content, '') = '' GROUP BY type, format
UNION ALL SELECT 'same_digest', sha256, count(*), true FROM a WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT 'orphan_room', concat('doc-', -1 - id), 1, true FROM c WHERE id % 50 = 0""")
def q_database_report(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    df = s.withColumns({"content": F.when(F.col("id") % 9 == 4, "").otherwise(F.col("content")), "sha256": F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.floor(F.col("id") / 6)))})
    listing = s.where("file_exists").select(F.col("file_path").alias("path"))
    rooms = s.where("id % 50 = 0").select(F.explode(F.array("id", -1 - F.col("id"))).alias("i")).select(F.concat(F.lit("doc-"), "i").alias("name"))
    return reports.database(df, listing, rooms)


@query("s_markdown_files", SHELF_SQL + TAGS_SQL + """, t AS (SELECT id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM b GROUP BY id), n AS (SELECT *, row_number() OVER (ORDER BY created_minute DESC, id) AS nth FROM s WHERE NOT deleted AND type = 'note')
SELECT nth, printf('%03d-%s.md', nth, title) AS name, type, concat('# ', title, chr(10), chr(10), '标签：', tags, chr(10), chr(10), coalesce(content, ''), chr(10)) AS body FROM n JOIN t USING (id)""")
def s_markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return exports.markdown_files(df, tags(df))


@query("s_backup_lines", SHELF_SQL + " SELECT CAST(to_json({'id': id, 'title': title, 'author': author, 'language': language, 'deleted': deleted, 'file_size': file_size}) AS VARCHAR) AS line FROM s")
def s_backup_lines(spark: SparkSession, sf: str) -> DataFrame:
    return exports.backup_lines(shelf(spark, sf).select("id", "title", "author", "language", "deleted", "file_size"))
