"""Queries over quality names, retrieval measures, anchors, review previews, queue changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, notes, queue, review, vectors
from ..operators.shelf_filter import ShelfFilter
from ..sources.tables import SHELF_SQL, TAGS_SQL, shelf, table, tags
from .base import query
from .shelf import ISSUES, N, scoped, snapshot

_ALIVE = SHELF_SQL + ", a AS (SELECT * FROM s WHERE NOT deleted AND type IN ('book', 'pdf'))"


@query("f_quality_kinds", _ALIVE + ISSUES + f""", q AS (SELECT a.*, CASE WHEN i.checked_minute IS NOT NULL THEN i.issues END AS codes FROM a LEFT JOIN i USING (id)),
r AS (SELECT id, {N} = 0 AS e, {N} > 0 AND {N} < 500 AS s, cover_path IS NULL AS c, collection IS NULL AS u, coalesce(language, '') <> '' AND language NOT IN ('zh', 'en', 'ja', 'und') AS v,
 coalesce(list_contains(codes, 'needs_ocr'), false) AS o, coalesce(list_contains(codes, 'missing_file'), false) AS m, coalesce(list_contains(codes, 'duplicate_sha'), false) AS d, codes IS NULL AS n FROM q),
k AS (SELECT unnest(list_filter([CASE WHEN e THEN 'empty_content' END, CASE WHEN s THEN 'short_content' END, CASE WHEN c THEN 'no_cover' END, CASE WHEN u THEN 'unclassified' END, CASE WHEN v THEN 'language_variant' END,
 CASE WHEN o THEN 'needs_ocr' END, CASE WHEN m THEN 'missing_file' END, CASE WHEN d THEN 'duplicate' END, CASE WHEN n THEN 'not_audited' END, CASE WHEN e OR s OR c OR u OR v OR o OR m OR d THEN 'issues' END], lambda x: x IS NOT NULL)) AS kind, id FROM r)
SELECT kind, count(*) AS n, sum(id) AS ids FROM k GROUP BY kind""")
def f_quality_kinds(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    rows = catalog.quality_kinds(df, snapshot(df))
    return rows.select("id", F.explode("quality").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


#: Anchors made up from ids, with wrong types and broken JSON among them.
ANCHOR = """CASE id % 8 WHEN 0 THEN concat('{"chapter": ', id % 5, ', "page": 3}') WHEN 1 THEN concat('{"page": ', id % 9, '}') WHEN 2 THEN '{"chapter": "2", "page": 4}' WHEN 3 THEN '{"chapter": 1.5}'
 WHEN 4 THEN '{"chapter": -1, "page": 0}' WHEN 5 THEN 'no json' WHEN 6 THEN '{"chapter": null, "page": {"n": 1}}' END"""


@query("g_anchor_positions", SHELF_SQL + f", a AS (SELECT id, {ANCHOR} AS anchor FROM s), j AS (SELECT id, CASE WHEN json_valid(anchor) THEN CAST(anchor AS JSON) END AS j FROM a), "
       "p AS (SELECT id, CASE WHEN json_type(j, '$.chapter') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(j, '$.chapter') AS BIGINT) END AS c, CASE WHEN json_type(j, '$.page') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(j, '$.page') AS BIGINT) END AS p FROM j) "
       "SELECT id, CASE WHEN c >= 0 THEN concat('章节 ', c) WHEN p > 0 THEN concat('第 ', p, ' 页') ELSE '' END AS position FROM p")  # fmt: skip
def g_anchor_positions(spark: SparkSession, sf: str) -> DataFrame:
    at = notes.place_in(F.col("anchor"))
    rows = shelf(spark, sf).selectExpr("id", f"{ANCHOR} AS anchor").select("id", at.alias("p"))
    return rows.select("id", notes.place_text(F.col("p.chapter"), F.col("p.page")).alias("position"))


_STATES = "id % 40 AS days, 1.3 + (id % 15) / 10.0 AS ease, CAST(id % 4 AS INTEGER) AS reps"


def _words(days: str) -> str:
    return f"CASE WHEN {days} = 0 THEN '10 分钟' ELSE concat(greatest({days}, 1), ' 天') END"


@query("r_rating_preview", SHELF_SQL + f", c AS (SELECT id, {_STATES} FROM s), g AS (SELECT id, least(36500, greatest(1, CAST(floor(days * 1.2) AS BIGINT))) AS h, CASE WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 3 ELSE least(36500, greatest(1, CAST(floor(days * CAST(ease AS DOUBLE)) AS BIGINT))) END AS g,"
       " CASE WHEN reps = 0 THEN 4 ELSE least(36500, greatest(1, CAST(floor(days * CAST(ease AS DOUBLE) * 1.3) AS BIGINT))) END AS e FROM c) "
       f"SELECT id, '10 分钟' AS again, {_words('h')} AS hard, {_words('g')} AS good, {_words('e')} AS easy FROM g")  # fmt: skip
def r_rating_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).selectExpr("id", *_STATES.split(", "))
    state = F.struct(F.col("days").cast("int").alias("interval"), F.col("ease").cast("double").alias("ease"), "reps", F.lit(0).alias("lapses"))
    return rows.select("id", review.preview(state).alias("p")).select("id", "p.*")


@query("r_queue_patched", SHELF_SQL + """, q AS (SELECT id * 3 AS id, id, id AS k FROM s WHERE id % 2 = 0),
c AS (SELECT id * 3 AS id, id AS k FROM s WHERE id % 4 <> 1)
SELECT CASE WHEN k % 2 <> 0 THEN 'not_found' WHEN k % 5 = 0 THEN 'no_fields' WHEN k % 5 = 1 THEN 'bad_status' ELSE 'updated' END AS outcome, count(*) AS n, sum(CASE WHEN k % 2 = 0 AND k % 5 > 1 THEN greatest(0, least(1000, k * 7 - 500)) ELSE 0 END) AS priorities FROM c GROUP BY 1""")
def r_queue_patched(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    rows = df.where("id % 2 = 0").selectExpr("id * 3 AS id", "id AS document_id", "0L AS priority", "'' AS note", "'active' AS status", "0 AS updated_minute")
    given = F.when(F.col("k") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("priority"), F.lit("status")))
    status = F.when(F.col("k") % 5 == 1, "gone").otherwise("paused")
    changes = df.where("id % 4 <> 1").select((F.col("id") * 3).alias("id"), F.col("id").alias("k")).select("id", given.alias("given"), (F.col("k") * 7 - 500).alias("priority"), F.lit("x").alias("note"), status.alias("status"))
    after, outcomes = queue.patched(rows, changes, 9)
    set_ = after.where("updated_minute = 9 AND status = 'paused' AND note = ''").select("id", "priority")
    return outcomes.join(set_, "id", "left").groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.coalesce("priority", F.lit(0))).alias("priorities"))


@query("v_documents_by_chunk", """WITH r AS (SELECT user_id AS query_id, event_id % 7 AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
f AS (SELECT query_id, doc, min(rank) AS m FROM r GROUP BY query_id, doc) SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m, doc) AS INTEGER) AS rank FROM f""")
def v_documents_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.by_document(_chunks(spark, sf), "doc")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 7).alias("doc"), nth.alias("rank"))


@query("v_retrieval_compared", """WITH r AS (SELECT user_id AS query_id, event_id % 7 AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
f AS (SELECT query_id, doc, min(rank) AS m FROM r GROUP BY query_id, doc), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, doc) AS n, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, doc) AS o FROM f),
j AS (SELECT DISTINCT query_id, (query_id * 3 + k) % 7 AS doc FROM f, range(2) t(k)), p AS (SELECT j.query_id, count(b.doc) FILTER (b.n <= 3) / 3.0 AS n, count(b.doc) FILTER (b.o <= 3) / 3.0 AS o FROM j LEFT JOIN b ON b.query_id = j.query_id AND b.doc = j.doc GROUP BY j.query_id)
SELECT count(*) AS queries, avg(n) AS mean_new, avg(o) AS mean_old, count(*) FILTER (n > o) AS better, count(*) FILTER (n = o) AS equal, count(*) FILTER (n >= o) AS not_worse FROM p""")
def v_retrieval_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Two orders of the same documents against two judged documents a query."""
    ranked = _chunks(spark, sf)
    item = F.col("doc").alias("item")
    judged = ranked.select("query_id").distinct().select("query_id", F.explode(F.array((F.col("query_id") * 3) % 7, (F.col("query_id") * 3 + 1) % 7)).alias("item"))
    back = ranked.groupBy("query_id", "doc").agg((-F.min("rank")).alias("rank"))
    new, old = (vectors.retrieval_quality(vectors.by_document(r, "doc").select("query_id", item, "rank"), judged, 3) for r in (ranked, back))
    return vectors.compared(new, old)


@query("v_chunk_statistics", "WITH c AS (SELECT least(CAST(ceil(n_chars / 680.0) AS BIGINT), 200) AS n FROM documents) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, avg(n) AS mean, median(n) AS median, max(n) AS largest, count(*) FILTER (n >= 200) AS capped FROM c")
def v_chunk_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.chunk_statistics(table(spark, sf, "documents").select(vectors.chunk_count(F.col("n_chars")).alias("n")))


@query("f_shelf_filter", _ALIVE + ISSUES + TAGS_SQL + f""", h AS (SELECT a.* FROM a JOIN i USING (id) WHERE progress > 0 AND progress < 1 AND format IN ('pdf', 'epub', 'txt') AND (contains(lower(a.title), 'title') OR contains(lower(content), 'title'))
 AND id IN (SELECT id FROM b WHERE tag = 't2') AND (length(trim(coalesce(content, ''))) < 500 OR cover_path IS NULL OR collection IS NULL OR (coalesce(language, '') <> '' AND language NOT IN ('zh', 'en', 'ja', 'und'))
 OR (i.checked_minute IS NOT NULL AND (list_contains(issues, 'needs_ocr') OR list_contains(issues, 'missing_file') OR list_contains(issues, 'duplicate_sha')))))
SELECT id, title FROM h ORDER BY title, id LIMIT 15 OFFSET 1""")
def f_shelf_filter(spark: SparkSession, sf: str) -> DataFrame:
    """What a user typed, as one filter over rows, tags and the last audit."""
    df = shelf(spark, sf)
    spec = ShelfFilter.parse({"q": " Title ", "shelf": "reading", "quality": "issues", "tag": "t2", "sort": "title_asc", "view": "odd", "format": ""})
    return spec.page(df, tags(df), snapshot(scoped(spark, sf)), 15, 1).select("id", "title")
