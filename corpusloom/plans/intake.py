"""Queries over imports: pages, files, clients' JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intake
from ..sources.tables import SHELF_SQL, shelf, table
from .base import query

TEXT = "html"
for _p in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->", "<[^>]*>"):
    TEXT = f"regexp_replace({TEXT}, '{_p}', ' ', 'gis')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&nbsp;", " "), ("&amp;", "&")):
    TEXT = f"replace({TEXT}, '{_a}', '{_b}')"
TEXT = f"trim(regexp_replace({TEXT}, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"


@query("s_page_text", f"SELECT page_id, substr({TEXT}, 1, 200000) AS text FROM pages")
def s_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", intake.page_text(F.col("html")).alias("text"))


@query("s_clip", "WITH t AS (SELECT url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS a, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS b, html FROM pages) SELECT url, coalesce(nullif(" + TEXT.replace("(html,", "(a,").replace("html", "a", 0) + ", ''), nullif(" + TEXT.replace("(html,", "(b,") + f", ''), url) AS title, substr({TEXT}, 1, 200) AS excerpt FROM t")
def s_clip(spark: SparkSession, sf: str) -> DataFrame:
    return intake.clip(table(spark, sf, "pages"))


@query("s_sniff", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS image, CASE WHEN page_id % 6 = 4 THEN 'pdf' WHEN page_id % 6 = 5 THEN CASE WHEN contains(lower(substr(html, 1, 500)), '<html') OR contains(lower(substr(html, 1, 500)), '<!doctype html') THEN 'html' ELSE 'text' END ELSE 'text' END AS kind FROM pages")
def s_sniff(spark: SparkSession, sf: str) -> DataFrame:
    head = F.expr("CASE page_id % 6 WHEN 0 THEN X'FFD8FFE0' WHEN 1 THEN X'89504E470D0A1A0A00' WHEN 2 THEN X'474946383961' WHEN 3 THEN X'52494646000000005745425056' WHEN 4 THEN X'255044462D' ELSE CAST(substring(html, 1, 500) AS binary) END")
    return table(spark, sf, "pages").select("page_id", intake.image_kind(head).alias("image"), intake.text_kind(head).alias("kind"))


@query("s_safe_paths", SHELF_SQL + ", p AS (SELECT id, CASE id % 5 WHEN 0 THEN concat('/in/a/', id) WHEN 1 THEN concat('/in/../x/', id) WHEN 2 THEN '/etc/x' WHEN 3 THEN '/inner/x' ELSE '/in/a\\b' END AS path FROM s) SELECT id, substr(sha256(path), 1, 12) AS directory, id % 5 = 0 AS safe FROM p")
def s_safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("CASE id % 5 WHEN 0 THEN concat('/in/a/', id) WHEN 1 THEN concat('/in/../x/', id) WHEN 2 THEN '/etc/x' WHEN 3 THEN '/inner/x' ELSE concat('/in/a', char(92), 'b') END")
    return shelf(spark, sf).select("id", intake.directory_id(path).alias("directory"), intake.inside(path, "/in/").alias("safe"))


LISTING = ", f AS (SELECT concat('/in/dir', id % 7, '/book ', id % 40, '.txt') AS path, concat('book ', id % 40) AS name, file_size AS size, id FROM s WHERE id % 3 <> 0)"


def listing(df: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/in/dir"), F.col("id") % 7, F.lit("/book "), F.col("id") % 40, F.lit(".txt"))
    return df.where("id % 3 <> 0").select(path.alias("path"), F.concat(F.lit("book "), F.col("id") % 40).alias("name"), F.col("file_size").alias("size"), "id")


@query("s_import_outcomes", SHELF_SQL + ", f AS (SELECT concat('p', id) AS path, concat('n', id % 40) AS name, file_size AS size, id FROM s WHERE id % 3 <> 0), r AS (SELECT concat('p', s.id) AS path, f.size, row_number() OVER (PARTITION BY f.name, f.size ORDER BY s.id) AS n, f.name IS NOT NULL AND f.name IN (SELECT concat('n', id) FROM s WHERE id < 10) AS k FROM s LEFT JOIN f ON f.path = concat('p', s.id)) SELECT path, CASE WHEN size IS NULL THEN 'failed' WHEN k OR n > 1 THEN 'duplicate' ELSE 'imported' END AS outcome FROM r")
def s_import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    files = df.where("id % 3 <> 0").select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("n"), F.col("id") % 40).alias("name"), F.col("file_size").alias("size"))
    known = df.where("id < 10").select(F.concat(F.lit("n"), "id").alias("name")).join(files.select("name", "size").distinct(), "name")
    return intake.outcomes(df.select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("nth")), files, known)


@query("s_folder_load", SHELF_SQL + LISTING + " SELECT name AS title, size, concat('dir', id % 7) AS category FROM f WHERE name NOT IN ('book 3', 'book 17')")
def s_folder_load(spark: SparkSession, sf: str) -> DataFrame:
    files = listing(shelf(spark, sf))
    known = files.where("name IN ('book 3', 'book 17')").select(F.col("name").alias("title"), "size").distinct()
    return intake.folder_load(files, known)


@query("s_scans", SHELF_SQL + ", u AS (SELECT concat('d', id % 2) AS directory, concat('p', id) AS path, CASE WHEN id % 4 = 0 THEN 'bad' ELSE 'importable' END AS kind FROM s), v AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY path) AS n FROM u) SELECT directory, path, kind, CAST(NULL AS BIGINT) AS n FROM v WHERE n <= 10 UNION ALL SELECT directory, NULL, kind, count(*) FROM u GROUP BY directory, kind")
def s_scans(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).select("id", F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") % 4 == 0, "bad").otherwise("importable").alias("kind"))
    preview, counts = intake.scans({f"d{i}": rows.where(F.col("id") % 2 == i) for i in (0, 1)}, 20)
    return preview.withColumn("n", F.lit(None).cast("long")).unionByName(counts.withColumn("path", F.lit(None).cast("string")))


@query("s_client_tables", SHELF_SQL + """, t AS (SELECT id, greatest(0, least(1, (id % 150) / 100.0)) AS p FROM s)
SELECT 'books' AS part, concat('b', id) AS id, CAST(p AS DOUBLE) AS progress, make_timestamp((1700000000000 + id) * 1000) AS at FROM t
UNION ALL SELECT 'notes', concat('n', id), NULL, make_timestamp((1700000000000 + id * 2) * 1000) FROM t WHERE id % 4 <> 0
UNION ALL SELECT 'bookmarks', concat('m', id), NULL, NULL FROM t
UNION ALL SELECT 'records', concat('b', id), NULL, make_timestamp((1700000000000 + id * 3) * 1000) FROM t""")
def s_client_tables(spark: SparkSession, sf: str) -> DataFrame:
    payload = shelf(spark, sf).selectExpr("""to_json(named_struct('books', array(named_struct('id', concat('b', id), 'title', title, 'progress', id % 150, 'addedAt', 1700000000000 + id)),
     'notes', array(named_struct('id', concat('n', id), 'bookId', CASE WHEN id % 4 = 0 THEN concat('gone', id) ELSE concat('b', id) END, 'text', 'x', 'createdAt', 1700000000000 + id * 2)),
     'bookmarks', array(named_struct('id', concat('m', id), 'bookId', concat('b', id), 'page', 3)), 'records', array(named_struct('bookId', concat('b', id), 'start', 1700000000000 + id * 3, 'end', 1700000000000 + id * 4)))) AS payload""")
    t, none, never = intake.client_tables(payload), F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    at = lambda c: F.col(c).cast("timestamp_ntz")
    out = t["books"].select(F.lit("books").alias("part"), "id", "progress", at("added_at").alias("at"))
    out = out.union(t["notes"].select(F.lit("notes"), "id", none, at("created_at"))).union(t["bookmarks"].select(F.lit("bookmarks"), "id", none, never))
    return out.union(t["records"].select(F.lit("records"), "bookId", none, at("start")))
