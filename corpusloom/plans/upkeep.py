"""Queries over language changes, extraction plans and logs, insights, annotation files, restores, two-step search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, intake, retrieval, review, upkeep
from ..sources.tables import SHELF_SQL, SQL, documents, shelf, table
from .base import query
from .intake import TEXT
from .notes import MARKS_SQL, STRIP, marks
from .retrieval import _APART, _ranked_words, document_index

_ALIVE = SHELF_SQL + ", a AS (SELECT * FROM s WHERE NOT deleted AND type IN ('book', 'pdf'))"
_TO = "CASE WHEN trim(coalesce(language, '')) = '' THEN 'und' WHEN lower(trim(language)) LIKE 'en%' THEN 'en' WHEN lower(trim(language)) LIKE 'zh%' THEN 'zh' WHEN lower(trim(language)) LIKE 'ja%' THEN 'ja' ELSE trim(language) END"


def _alive(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).where("NOT deleted AND type IN ('book', 'pdf')")


@query("q_language_transitions", _ALIVE + f" SELECT coalesce(language, '') AS from_code, {_TO} AS to_code, count(*) AS n FROM a WHERE language IS DISTINCT FROM {_TO} GROUP BY ALL")
def q_language_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.transitions(upkeep.language_changes(_alive(spark, sf)))


@query("q_language_report", _ALIVE + f", c AS (SELECT language IS DISTINCT FROM {_TO} AS x, {_TO} NOT IN ('en', 'zh', 'ja', 'und') AS u FROM a) SELECT count(*) AS total, count(*) FILTER (x) AS changed, count(*) FILTER (NOT x) AS unchanged, CAST(ceil(count(*) FILTER (x) / 500.0) AS BIGINT) AS batches, count(*) FILTER (u) AS unmapped FROM c")
def q_language_report(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.language_report(_alive(spark, sf))


_PATH = "CASE WHEN id % 17 = 0 THEN concat('files/../', id) WHEN id % 23 = 0 THEN concat('other/', id) ELSE file_path END"


@query("q_extract_reasons", SHELF_SQL + f", p AS (SELECT *, {_PATH} AS p FROM s) SELECT CASE WHEN coalesce(p, '') = '' THEN 'no_file' WHEN format NOT IN ('epub', 'txt') THEN concat('format:', format) WHEN p LIKE '%..%' OR p LIKE 'other/%' THEN 'illegal_path' WHEN NOT file_exists THEN 'file_missing' ELSE 'candidate' END AS reason, count(*) AS n FROM p GROUP BY 1")
def q_extract_reasons(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf).withColumn("file_path", F.expr(_PATH))
    return upkeep.extract_reasons(df, ("epub", "txt")).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_job_log", "SELECT 'reextract' AS kind, count(*) FILTER (doc_id % 4 = 0) AS updated, count(*) FILTER (doc_id % 4 = 1) AS skipped, count(*) FILTER (doc_id % 4 = 2) AS empty, count(*) FILTER (doc_id % 4 = 3) AS failed, false AS undoable FROM documents")
def q_job_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row for a job over all rows; a second one that updated nothing leaves none."""
    name = F.array(*[F.lit(x) for x in ("updated", "skipped", "empty", "failed")])[(F.col("id") % 4).cast("int")]
    out = documents(spark, sf).select("id", name.alias("outcome"))
    return upkeep.job_log(out).unionByName(upkeep.job_log(out.where("outcome <> 'updated'")))


@query("t_insight", SQL + r", e AS (SELECT id, coalesce(title, '') || ' ' || coalesce(content, '') AS t FROM d), " + _ranked_words("e") +
       r", y AS (SELECT id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(coalesce(content, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '[.!?。！？\n]+'), lambda x: trim(x)), lambda x: length(x) >= 8)[1] AS s FROM d) "
       + f"SELECT id, CASE WHEN length(s) > 100 THEN substr(s, 1, 100) || '…' ELSE s END AS summary, array_to_string(coalesce({_APART.format('l.l', 5)}, []), ' ') AS tags FROM y LEFT JOIN l USING (id)")
def t_insight(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.insight(documents(spark, sf)).select("id", "summary", F.array_join("tags", " ").alias("tags"))


_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n')"


@query("s_annotation_file", MARKS_SQL + f"""n AS (SELECT m.*, s.title AS b, s.deleted AS gone, {STRIP.format('quote')} AS q, {STRIP.format('note')} AS c FROM m JOIN s ON m.document_id = s.id)
SELECT concat({_ESC.format("CASE WHEN q <> '' THEN q ELSE c END")}, chr(9), {_ESC.format("CASE WHEN coalesce(quote, '') <> '' AND coalesce(note, '') <> '' THEN concat(c, chr(10), '— 《', b, '》') ELSE concat('— 《', b, '》') END")}, chr(9), 'highlight', chr(9), b) AS line FROM n WHERE NOT gone
UNION ALL SELECT concat(chr(65279), 'front', chr(9), 'back', chr(9), 'type', chr(9), 'book')""")
def s_annotation_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = marks(spark, sf).select("id", "document_id", "quote", F.col("note").alias("content"), F.lit("highlight").alias("type"), F.col("day").alias("created_minute"))
    return upkeep.annotation_file(rows, shelf(spark, sf))


@query("s_restore_tables", "SELECT 'supplier' AS name, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0) AS rows, (SELECT count(*) FROM supplier WHERE s_suppkey % 15 = 0) AS refused, (SELECT count(*) FROM supplier) AS after UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 0, (SELECT count(*) * 2 FROM nation)")
def s_restore_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables restored from rows of text; every fifth supplier has a key or balance that is no number."""
    supplier, nation = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    text = supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string"), F.lit("restored").alias("s_name"), F.when(F.col("s_suppkey") % 5 == 0, "no number").otherwise("1.5").alias("s_acctbal"), F.lit("x").alias("other"))
    names = nation.select((F.col("n_nationkey") + 1000).cast("string").alias("n_nationkey"), "n_name")
    after, counts = upkeep.restored_tables({"supplier": supplier, "nation": nation}, {"supplier": text, "nation": names}, {"supplier": "s_suppkey", "nation": "n_nationkey"})
    sizes = [df.agg(F.count("*").alias("after")).select(F.lit(n).alias("name"), "after") for n, df in after.items()]
    return counts.join(sizes[0].unionByName(sizes[1]), "name")


@query("m_batch_tags", SHELF_SQL + ", b AS (SELECT id, list_sort(list_distinct([concat('t', id % 5), concat('t', id * 7 % 9)])) AS t, title FROM s), w AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(t, lambda x: x <> 't1'), ['new']))) AS after FROM b WHERE id % 3 = 0) SELECT id, array_to_string(t, ',') AS before, array_to_string(after, ',') AS after FROM w")
def m_batch_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags as one more field of a batch: `new` comes, t1 goes; before and after are sorted lists."""
    df = shelf(spark, sf)
    tags = F.array_sort(F.array_distinct(F.array(F.concat(F.lit("t"), F.col("id") % 5), F.concat(F.lit("t"), F.col("id") * 7 % 9))))
    now = df.select("id", "title", tags.alias("tags"))
    merged = F.array_sort(F.array_union(F.array_except("tags", F.array(F.lit("t1"))), F.array(F.lit("new"))))
    batch = now.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("title"), merged.alias("tags"))
    out = changes.patch(now, batch, "id", ["title", "tags"])
    return out.select("id", F.array_join("before.tags", ",").alias("before"), F.array_join("after.tags", ",").alias("after"))


@query("l_refined_short", SQL + " SELECT id FROM d WHERE (contains(lower(title), 'ering') OR contains(lower(content), 'ering')) AND (contains(lower(title), 'zz') OR contains(lower(content), 'zz') OR contains(lower(content), '! '))")
def l_refined_short(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf)
    return retrieval.refined(document_index(spark, sf), df, ["ering"], ["zz", "! "]).select("id")


@query("f_plain_titles", SQL + r" SELECT id, NOT regexp_matches(title, '[\x00-\x1f\x7f]') AND length(title) > 0 AS fit FROM d")
def f_plain_titles(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", T.fit_title(F.col("title")).alias("fit"))


_BYTES = "CASE page_id % 5 WHEN 1 THEN concat('%PDF-1.4 ', html) WHEN 2 THEN 'plain words' ELSE html END"
_FORMAT = "CASE page_id % 5 WHEN 3 THEN 'epub' WHEN 4 THEN 'txt' ELSE 'PDF' END"


@query("s_extracted", f"WITH p AS (SELECT page_id, html, {_BYTES} AS c FROM pages) SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 3 THEN 'book' ELSE 'text' END AS reader, CASE WHEN page_id % 5 = 0 THEN substr({TEXT}, 1, 200000) WHEN page_id % 5 IN (2, 4) THEN substr(c, 1, 200000) END AS text FROM p")
def s_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Readers by first bytes, whatever a name says, and what they read."""
    rows = table(spark, sf, "pages").selectExpr("page_id", f"CAST({_BYTES} AS BINARY) AS content", f"{_FORMAT} AS format")
    return intake.extracted(rows).select("page_id", "reader", "text")


@query("a_last_active_days", "WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(greatest(0, value)) AS s FROM events GROUP BY 1) SELECT day FROM d WHERE s > 0 ORDER BY day DESC LIMIT 7")
def a_last_active_days(spark: SparkSession, sf: str) -> DataFrame:
    sessions = table(spark, sf, "events").select(F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 60e6).cast("long")).alias("end"))
    return review.last_active_days(review.minutes_by_day(sessions, "start", "end")).select("day")


@query("s_verify_files", SHELF_SQL + " SELECT CASE WHEN id % 5 = 0 THEN 'missing' WHEN id % 5 = 1 THEN 'size' WHEN id % 5 = 2 THEN 'hash' ELSE 'ok' END AS state, count(*) AS n FROM s GROUP BY 1")
def s_verify_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a manifest, digests of real texts, against a listing with some gone, longer or other."""
    files = shelf(spark, sf).select("id", F.concat(F.lit("p"), "id").alias("path"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    other = F.when(F.col("id") % 5 == 2, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))
    now = files.where("id % 5 <> 0").select("path", F.when(F.col("id") % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), other.alias("sha256"))
    return changes.verify(files.drop("id"), now).groupBy("state").agg(F.count("*").alias("n"))


@query("s_notes_by_title", SHELF_SQL + " SELECT title, concat('## ', title, chr(10), chr(10), string_agg(concat('- ', substr(content, 1, 20)), chr(10) ORDER BY id)) AS markdown FROM s GROUP BY title")
def s_notes_by_title(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).select("title", "id", F.substring("content", 1, 20).alias("note"))
    return changes.markdown_by_document(rows, "title", "id", "note")
