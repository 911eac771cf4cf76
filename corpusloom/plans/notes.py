"""Queries over notes, operations, addresses, chunks at punctuation and the reindex counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import addresses, catalog, changes, notes, vectors
from ..sources.tables import SHELF_SQL, shelf, table
from .base import query

#: Annotations made up from documents, in expressions that Spark and DuckDB read alike.
MARKS = (
    "id * 10 AS id", "id AS document_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE substr(content, 1, 60) END AS quote", "CASE WHEN id % 4 = 0 THEN '' ELSE concat(' mind ', title) END AS note",
    "CASE WHEN id % 5 = 0 THEN id % 9 END AS chapter", "id % 7 AS page", "id % 30 AS day", "CASE WHEN id % 11 = 0 THEN '' ELSE title END AS book",
)
MARKS_SQL = SHELF_SQL + ", m AS (SELECT " + ", ".join(MARKS) + " FROM s), "
STRIP = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
QUOTED = "CASE WHEN q <> '' THEN concat('> ', replace(regexp_replace(q, '\\r\\n|\\r', chr(10), 'g'), chr(10), concat(chr(10), '> '))) ELSE '' END"
JOINED = "list_filter([{}], lambda x: x <> '')"
ADDRESS_CASES = ("10.1.2.3", "8.8.8.8", "[::1]", "[::ffff:127.0.0.1]", "[2002:7f00:1::]", "[2001:db8::1]", "100.127.0.9:8080", "example.org:22", "example.org:443", "")


def marks(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).selectExpr(*MARKS)


@query("g_annotation_notes", MARKS_SQL + f"""n AS (SELECT m.*, {STRIP.format('quote')} AS q, {STRIP.format('note')} AS t, s.title AS b FROM m JOIN s ON m.document_id = s.id WHERE NOT s.deleted),
f AS (SELECT *, regexp_replace(CASE WHEN q <> '' THEN q ELSE t END, '\\s+', ' ', 'g') AS flat,
 concat('来源：[[', b, ']]', CASE WHEN chapter >= 0 THEN concat(' · 章节 ', chapter) WHEN page > 0 THEN concat(' · 第 ', page, ' 页') ELSE '' END) AS src FROM n)
SELECT id AS annotation_id, document_id, concat('《', b, '》', CASE WHEN flat = '' THEN '书签' ELSE concat(CASE WHEN q <> '' THEN '摘录：' ELSE '批注：' END, substr(flat, 1, 24), CASE WHEN length(flat) > 24 THEN '…' ELSE '' END) END) AS title,
 array_to_string({JOINED.format(QUOTED + ", t, src")}, concat(chr(10), chr(10))) AS content FROM f""")
def g_annotation_notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes.notes(marks(spark, sf), shelf(spark, sf))


@query("g_daily_sections", MARKS_SQL + f"""n AS (SELECT id, day, coalesce(nullif(book, ''), '未命名文档') AS book, {STRIP.format('quote')} AS q, {STRIP.format('note')} AS t FROM m),
f AS (SELECT *, array_to_string({JOINED.format(QUOTED + ", t")}, concat(chr(10), chr(10))) AS body FROM n WHERE q <> '' OR t <> '')
SELECT day, book, count(*) AS n, min(id) AS first, concat('### 《[[', book, ']]》', chr(10), chr(10), string_agg(body, concat(chr(10), chr(10)) ORDER BY id)) AS section FROM f GROUP BY day, book""")
def g_daily_sections(spark: SparkSession, sf: str) -> DataFrame:
    return notes.daily_sections(marks(spark, sf))


@query("m_operations_page", """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT id, kind, status, (SELECT count(*) FROM o) AS total FROM o ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10""")
def m_operations_page(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS kind", "o_orderstatus AS status", "o_orderdate AS created_at")
    return changes.operations(log, "1-URGENT", "F", 20, 10).select("id", "kind", "status", "total")


@query("x_url_refusal", f"""WITH u AS (SELECT page_id, url, CASE page_id % 12 WHEN 10 THEN url WHEN 11 THEN 'ftp://example.org/' ELSE concat('https://', ([{", ".join(f"'{x}'" for x in ADDRESS_CASES)}])[CAST(page_id % 12 + 1 AS INT)], '/x') END AS asked FROM pages)
SELECT page_id, CASE WHEN page_id % 12 IN (0, 2, 3, 4, 6) THEN 'address' WHEN page_id % 12 = 7 THEN 'port' WHEN page_id % 12 = 9 THEN 'host' WHEN page_id % 12 = 11 THEN 'scheme' END AS refusal FROM u""")
def x_url_refusal(spark: SparkSession, sf: str) -> DataFrame:
    nth = F.col("page_id") % 12
    host = F.get(F.array(*map(F.lit, ADDRESS_CASES)), nth.cast("int"))
    asked = F.when(nth == 10, F.col("url")).when(nth == 11, "ftp://example.org/").otherwise(F.concat(F.lit("https://"), host, F.lit("/x")))
    return table(spark, sf, "pages").select("page_id", addresses.refusal(asked).alias("refusal"))


@query("v_cut_chunks")
def v_cut_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cut_chunks(shelf(spark, sf))


_LIST = "row_number() OVER (PARTITION BY lang ORDER BY {}) AS rank"


@query("v_hybrid", f"""WITH a AS (SELECT lang AS query_id, doc_id AS item, {_LIST.format('n_chars DESC, doc_id')} FROM documents), b AS (SELECT lang AS query_id, doc_id AS item, {_LIST.format('doc_id % 50, n_chars DESC, doc_id')} FROM documents),
f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank <= 5) GROUP BY ALL)
SELECT query_id, item, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item) AS rank FROM f) WHERE rank <= 5""")
def v_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item"), "n_chars")
    ranked = lambda *order: docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return vectors.hybrid(ranked(F.desc("n_chars"), "item"), ranked(F.col("item") % 50, F.desc("n_chars"), "item"))


@query("q_reindex_counts", SHELF_SQL + """, d AS (SELECT *, format IN ('epub', 'txt') AND id % 2 = 0 AS asks, id % 5 <> 1 AS got FROM s WHERE NOT deleted AND file_path IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (asks AND got) AS updated, count(*) FILTER (NOT asks) AS skipped, count(*) FILTER (asks AND NOT got) AS empty, count(*) FILTER (id % 7 = 0 AND file_exists) AS sha_backfilled FROM d""")
def q_reindex_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf).withColumn("content", F.when(F.col("id") % 2 == 0, "").otherwise("x"))
    digest = F.when(F.col("id") % 7 != 0, "d")
    return catalog.reindex_counts(df, F.when(F.col("id") % 5 != 1, "new"), ("epub", "txt"), digest)
