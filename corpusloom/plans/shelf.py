"""Queries over shelves: facets, sorts, audits, plans, queue, links, routed search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, catalog, changes, linking, queue, search
from ..sources.tables import SHELF_SQL, TAGS_SQL, shelf, tags
from .base import query

ALIVE = SHELF_SQL + ", a AS (SELECT * FROM s WHERE NOT deleted AND type IN ('book', 'pdf'))"
FACET = "SELECT value, n, (SELECT count(*) FROM g) > {k} AS truncated FROM g ORDER BY n DESC, value LIMIT {k}"
N = "length(trim(coalesce(content, '')))"
NORM = "CASE lower(trim(coalesce(language, ''))) WHEN '' THEN 'und' WHEN 'en-us' THEN 'en' WHEN 'eng' THEN 'en' WHEN 'zh-hant' THEN 'zh' ELSE lower(trim(language)) END"
ISSUES = f""", f AS (SELECT *, {N} AS n, CASE WHEN {N} > 0 THEN count(*) OVER (PARTITION BY content) ELSE 1 END AS k FROM a),
i AS (SELECT id, title, n, k, updated_minute, checked_minute, list_filter([CASE WHEN file_path IS NOT NULL AND NOT file_exists THEN 'missing_file' END,
 CASE WHEN cover_path IS NOT NULL AND NOT cover_exists THEN 'orphan_cover' END, CASE WHEN n = 0 THEN 'empty_content' END, CASE WHEN n > 0 AND n < 500 THEN 'short_content' END,
 CASE WHEN cover_path IS NULL THEN 'no_cover' END, CASE WHEN collection IS NULL THEN 'unclassified' END, CASE WHEN format = 'pdf' AND n < 500 AND file_exists THEN 'needs_ocr' END,
 CASE WHEN language <> '' AND lower(trim(language)) NOT IN ('zh', 'en', 'ja', 'und') THEN 'language_variant' END, CASE WHEN k > 1 THEN 'duplicate_sha' END], lambda x: x IS NOT NULL) AS issues FROM f)"""
CODES = ("missing_file", "orphan_cover", "empty_content", "short_content", "no_cover", "unclassified", "needs_ocr", "language_variant", "duplicate_sha")
RULES = [("src1", ["worthless", "title 1"]), ("src2", ["buy", "!!"]), ("forms", [" | ", "###"]), ("src3", ["idiot", "title 3"])]


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.alive(shelf(spark, sf), catalog.SCOPE)


def snapshot(df: DataFrame) -> DataFrame:
    return catalog.audit(df).join(df.select("id", "checked_minute"), "id").where("checked_minute IS NOT NULL")


@query("f_tag_filter", ALIVE + TAGS_SQL + " SELECT id FROM a WHERE id IN (SELECT id FROM b WHERE tag = 't1') AND id IN (SELECT id FROM b WHERE tag = 't7')")
def f_tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    return catalog.with_tags(df, tags(df), "t1", "t7").select("id")


@query("f_lookup", SHELF_SQL + " SELECT id, title FROM s WHERE id IN (12, 13) AND NOT deleted UNION ALL SELECT id, title FROM s WHERE id = 13")
def f_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    found = catalog.lookup(df, 12).union(catalog.lookup(df, 13)).union(catalog.lookup(df, 13, include_deleted=True))
    return found.select("id", "title")


@query("a_facet_tags", ALIVE + TAGS_SQL + ", g AS (SELECT tag AS value, count(DISTINCT id) AS n FROM b JOIN a USING (id) GROUP BY tag) " + FACET.format(k=5))
def a_facet_tags(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    return catalog.tag_facet(df, tags(df), 5)


@query("a_facet_authors", ALIVE + ", g AS (SELECT author AS value, count(*) AS n FROM a WHERE trim(author) <> '' GROUP BY author) " + FACET.format(k=8))
def a_facet_authors(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.author_facet(scoped(spark, sf), 8)


@query("a_facet_categories", ALIVE + " SELECT collection, CASE WHEN collection <> 'src3' THEN 'name of ' || collection END AS name, count(*) AS n FROM a GROUP BY collection")
def a_facet_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = shelf(spark, sf).where("name <> 'src3'").select(F.col("name").alias("collection"), F.concat(F.lit("name of "), "name").alias("name")).distinct()
    return catalog.category_facet(scoped(spark, sf), names)


@query("a_facet_languages", ALIVE + f" SELECT {NORM} AS language, count(*) AS n FROM a GROUP BY 1")
def a_facet_languages(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_reason(scoped(spark, sf).withColumn("language", T.language(F.col("language"))), "language")


@query("q_language_readings", SHELF_SQL + f" SELECT id, CASE WHEN {NORM} IN ('zh', 'en', 'ja', 'und') THEN {NORM} ELSE 'und' END AS audited, CASE WHEN lower(trim(language)) LIKE 'en%' THEN 'en' WHEN lower(trim(language)) LIKE 'zh%' THEN 'zh' WHEN lower(trim(language)) LIKE 'ja%' THEN 'ja' ELSE language END AS by_prefix FROM s")
def q_language_readings(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("language")
    return shelf(spark, sf).select("id", catalog.standard_language(c).alias("audited"), catalog.language_by_prefix(c).alias("by_prefix"))


@query("a_by_type", SHELF_SQL + " SELECT type, count(*) AS n, count(*) FILTER (coalesce(progress, 0) > 0) AS started, count(*) FILTER (coalesce(progress, 0) >= 1) AS completed FROM s WHERE NOT deleted GROUP BY type")
def a_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_type(catalog.alive(shelf(spark, sf)))


@query("a_empty_by_two", ALIVE + f" SELECT type, format, count(*) AS n FROM a WHERE {N} < 500 GROUP BY type, format")
def a_empty_by_two(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_reason(scoped(spark, sf).where(F.length(F.trim(F.coalesce("content", F.lit("")))) < 500), "type", "format")


ORDERS = {
    "created_desc": "created_minute DESC, id DESC", "created_asc": "created_minute, id", "title_asc": "title, id", "author_asc": "coalesce(author, ''), title, id",
    "last_read_desc": "read_minute DESC NULLS LAST, id DESC", "progress_desc": "coalesce(progress, 0) DESC, id DESC", "file_size_desc": "coalesce(file_size, 0) DESC, id DESC",
}


@query("o_named_sorts", ALIVE + " " + " UNION ALL ".join(f"(SELECT '{k}' AS sort, id FROM a ORDER BY {v} LIMIT 20 OFFSET 3)" for k, v in ORDERS.items()))
def o_named_sorts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in catalog.SORTS:
        page = catalog.sort(scoped(spark, sf), name, 20, 3).select(F.lit(name).alias("sort"), "id")
        out = page if out is None else out.union(page)
    return out


@query("q_audit_nine", ALIVE + ISSUES + " SELECT id, CAST(n AS BIGINT) AS content_chars, k AS group_size, array_to_string(issues, ',') AS issues FROM i")
def q_audit_nine(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.audit(scoped(spark, sf)).withColumn("issues", F.array_join("issues", ","))


@query("q_issue_list", ALIVE + ISSUES + ", h AS (SELECT id, title, array_to_string(issues, ',') AS issues FROM i WHERE list_contains(issues, 'no_cover')) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY title, id LIMIT 30 OFFSET 5")
def q_issue_list(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    return catalog.with_issue(catalog.audit(df), df, "no_cover", 30, 5).withColumn("issues", F.array_join("issues", ","))


@query("a_quality_summary", ALIVE + ISSUES + ", c AS (SELECT *, CASE WHEN checked_minute IS NOT NULL THEN issues ELSE [] END AS x FROM i) SELECT count(*) AS total, count(checked_minute) AS audited, count(*) FILTER (checked_minute IS NULL OR updated_minute > checked_minute) AS stale, max(checked_minute) AS last_audit, " + ", ".join(f"count(*) FILTER (list_contains(x, '{c}')) AS {c}" for c in CODES) + " FROM c")
def a_quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    return catalog.quality_summary(df, snapshot(df), CODES)


@query("f_snapshot_arms", ALIVE + ISSUES + " SELECT 'not_audited' AS arm, id FROM i WHERE checked_minute IS NULL" + "".join(f" UNION ALL SELECT '{a}', id FROM i WHERE checked_minute IS NOT NULL AND list_contains(issues, '{c}')" for a, c in (("needs_ocr", "needs_ocr"), ("missing_file", "missing_file"), ("duplicate", "duplicate_sha"))))
def f_snapshot_arms(spark: SparkSession, sf: str) -> DataFrame:
    df = scoped(spark, sf)
    arms = [F.lit(x) for x in ("not_audited", "needs_ocr", "missing_file", "duplicate")]
    return catalog.quality_kinds(df, snapshot(df)).select(F.explode(F.array_intersect("quality", F.array(*arms))).alias("arm"), "id")


CATEGORY = "CASE WHEN contains(lower({c}), 'worthless') OR contains(lower({c}), 'title 1') THEN 'src1' WHEN contains(lower({c}), 'buy') OR contains(lower({c}), '!!') THEN 'src2' WHEN contains(lower({c}), ' | ') OR contains(lower({c}), '###') THEN 'forms' WHEN contains(lower({c}), 'idiot') OR contains(lower({c}), 'title 3') THEN 'src3' END"


def _occurs(word: str) -> str:
    return f"(length(lower(content)) - length(replace(lower(content), '{word}', ''))) // {len(word)} * {2 * len(word) if len(word) > 2 else 1}"


SCORED = (
    "x AS (SELECT *, [" + ", ".join("{'n': " + " + ".join(_occurs(w) for w in words) + f", 'i': {i}, 'c': '{name}'}}" for i, (name, words) in enumerate(RULES)) + "] AS v FROM a),"
    " y AS (SELECT *, list_sort(list_transform(v, lambda e: {'m': -e.n, 'i': e.i, 'c': e.c})) AS r FROM x), z AS (SELECT *, CASE WHEN -r[1].m >= 4 AND -r[1].m >= 1.5 * -r[2].m THEN r[1].c END AS scored FROM y)"
)


@query("q_tiered_plan", ALIVE + ", " + SCORED + f", p AS (SELECT id, collection, coalesce({CATEGORY.format(c='title')}, scored) AS category FROM z) SELECT category, CASE WHEN category IS NULL THEN 'no match' WHEN category NOT LIKE 'src%' THEN 'unknown category' WHEN collection IS NOT DISTINCT FROM category THEN 'already there' WHEN collection IS NOT NULL AND collection NOT IN ('src0', 'src5') THEN 'not in a catch-all' ELSE 'move' END AS outcome, count(*) AS n FROM p GROUP BY 1, 2")
def q_tiered_plan(spark: SparkSession, sf: str) -> DataFrame:
    category = catalog.tiered(F.col("title"), F.col("content"), RULES, audit.classify_by_rules, audit.classify_by_score)
    known = shelf(spark, sf).select("name").distinct()
    return catalog.by_reason(catalog.classify_plan(scoped(spark, sf), category, known, ("src0", "src5")), "category", "outcome")


NEW = "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN substr(content, 1, 50) WHEN 3 THEN content ELSE concat(content, ' more') END"


@query("q_extract_plan", ALIVE + f", n AS (SELECT *, {NEW} AS t FROM a) SELECT mode, CASE WHEN file_path IS NULL OR format NOT IN ('pdf', 'epub') THEN 'skipped' WHEN NOT file_exists OR t IS NULL THEN 'failed' WHEN t = '' THEN 'empty' WHEN CASE WHEN mode = 'longer' THEN length(t) <= length(content) ELSE t = content END THEN 'skipped' ELSE 'updated' END AS outcome, count(*) AS n FROM n, (VALUES ('longer'), ('always')) m(mode) GROUP BY 1, 2")
def q_extract_plan(spark: SparkSession, sf: str) -> DataFrame:
    df, out = scoped(spark, sf), None
    for mode in ("longer", "always"):
        plan = catalog.extract_plan(df, F.expr(NEW), ("pdf", "epub"), mode == "longer").withColumn("mode", F.lit(mode))
        out = plan if out is None else out.union(plan)
    return catalog.by_reason(out, "mode", "outcome")


@query("q_near_exact", SHELF_SQL + ", r AS (SELECT id, first_value(id) OVER w AS keeper, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY title, file_size ORDER BY created_minute, id)) SELECT id, keeper FROM r WHERE n > 1")
def q_near_exact(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.near_exact(shelf(spark, sf))


# --- queue and cards

QUEUE = ", q AS (SELECT id AS qid, id AS document_id, id % 1300 - 100 AS p, id % 3 AS sort_order, CASE WHEN id % 9 = 0 THEN 'done' ELSE 'active' END AS status, created_minute FROM s WHERE id % 2 = 0)"
NOTES = ", n AS (SELECT id * 10 AS nid, id AS document_id, CASE id % 4 WHEN 0 THEN 'bookmark' WHEN 1 THEN 'note' ELSE 'highlight' END AS kind, created_minute, substr(content, 1, 60) AS quote, substr(content, 100, 60) AS note FROM s)"
CARDS = ", c AS (SELECT nid, kind, created_minute + nid % 20000 AS due_minute, CASE WHEN nid % 30 = 0 THEN 'suspended' ELSE 'active' END AS status, created_minute + 500 AS rated_minute FROM n WHERE nid % 3 = 0)"


def items(df: DataFrame) -> DataFrame:
    q = df.where("id % 2 = 0")
    fields = queue.item((F.col("id") % 1300 - 100), F.repeat(F.lit("n"), 600))
    return q.select("id", F.col("id").alias("document_id"), *fields, (F.col("id") % 3).alias("sort_order"), F.when(F.col("id") % 9 == 0, "done").otherwise("active").alias("status"), "created_minute")


def annotations(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("id") % 4 == 0, "bookmark").when(F.col("id") % 4 == 1, "note").otherwise("highlight")
    return df.select((F.col("id") * 10).alias("id"), F.col("id").alias("document_id"), kind.alias("type"), "created_minute", F.substring("content", 1, 60).alias("quote"), F.substring("content", 100, 60).alias("note"))


def cards(df: DataFrame) -> DataFrame:
    rows = annotations(df).where("id % 3 = 0")
    return rows.select("id", (F.col("created_minute") + F.col("id") % 20000).alias("due_minute"), F.when(F.col("id") % 30 == 0, "suspended").otherwise("active").alias("status"), (F.col("created_minute") + 500).alias("rated_minute"))


@query("r_queue_order", SHELF_SQL + QUEUE + " SELECT document_id, title, greatest(0, least(1000, p)) AS priority, sort_order, 500 AS note_length FROM q JOIN s ON s.id = q.document_id WHERE NOT deleted AND status = 'active' ORDER BY greatest(0, least(1000, p)), sort_order, q.created_minute, qid LIMIT 25")
def r_queue_order(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return queue.in_order(items(df), df).limit(25).select("document_id", "title", "priority", "sort_order", F.length("note").alias("note_length"))


@query("r_queue_reorder", SHELF_SQL + QUEUE + " SELECT qid AS id, CASE qid WHEN 8 THEN 0 WHEN 2 THEN 1 WHEN 40 THEN 2 ELSE sort_order END AS sort_order FROM q")
def r_queue_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return queue.reordered(items(shelf(spark, sf)), [8, 2, 40]).select("id", "sort_order")


@query("r_queue_adding", SHELF_SQL + QUEUE + " SELECT id, CASE WHEN deleted OR type = 'note' OR coalesce(progress, 0) <= 0 OR progress >= 1 THEN 'not_applicable' WHEN id IN (SELECT document_id FROM q WHERE qid % 4 = 0) THEN 'exists' ELSE 'created' END AS outcome FROM s")
def r_queue_adding(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return queue.adding(df, items(df).where("id % 4 = 0"))


@query("r_new_cards", SHELF_SQL + NOTES + " SELECT nid AS id FROM n WHERE kind <> 'bookmark' AND nid % 3 <> 0 AND document_id NOT IN (SELECT id FROM s WHERE deleted)")
def r_new_cards(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return queue.new_cards(annotations(df), df, cards(df)).select("id")


@query("w_stagger", SHELF_SQL + NOTES + ", r AS (SELECT nid, row_number() OVER (ORDER BY created_minute, nid) AS nth FROM n) SELECT nid AS id, nth, nth % 14 AS day FROM r")
def w_stagger(spark: SparkSession, sf: str) -> DataFrame:
    return queue.staggered(annotations(shelf(spark, sf))).select("id", "nth", "day")


@query("a_card_counters", SHELF_SQL + NOTES + CARDS + """, t AS (SELECT 9000 AS now, (9000 + 480) // 1440 * 1440 - 480 AS d)
SELECT (SELECT count(*) FROM c, t WHERE status = 'active' AND due_minute <= now) AS due_now, (SELECT count(*) FROM c, t WHERE status = 'active' AND due_minute > now AND due_minute < d + 1440) AS due_today,
 (SELECT count(*) FROM c, t WHERE status = 'active' AND due_minute > now AND due_minute <= now + 10080) AS upcoming_7d, (SELECT count(*) FROM c, t WHERE rated_minute >= d AND rated_minute < d + 1440) AS reviewed_today,
 (SELECT count(*) FROM n, t WHERE kind IN ('note', 'highlight') AND created_minute >= d AND created_minute < d + 1440) AS new_today""")
def a_card_counters(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return queue.counters(cards(df), annotations(df), 9000, 480)


@query("r_annotations_since", SHELF_SQL + NOTES + " SELECT nid AS id FROM n WHERE created_minute >= 3000 AND kind = 'note' ORDER BY created_minute DESC, nid DESC LIMIT 40 OFFSET 4")
def r_annotations_since(spark: SparkSession, sf: str) -> DataFrame:
    return queue.since(annotations(shelf(spark, sf)), 3000, ("note",), 40, 4).select("id")


@query("l_annotations", SHELF_SQL + NOTES + " SELECT nid AS id, document_id, title FROM n JOIN s ON s.id = n.document_id WHERE NOT deleted AND (contains(lower(quote), 'tion') OR contains(lower(note), 'tion')) ORDER BY n.created_minute DESC, nid DESC LIMIT 50")
def l_annotations(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return search.in_annotations(annotations(df), df, "TION")


# --- links

LINKS = ", l AS (SELECT id AS source, id * 7 % 20 AS target, CASE WHEN id % 2 = 0 THEN 'cite' ELSE 'relate' END AS kind FROM s)"
TOLD = ", m AS (SELECT *, concat('See [[title ', CAST(id * 3 % 130 AS string), ']] and [[Lost ', CAST(id % 4 AS string), ']] [[Lost ', CAST(id % 4 AS string), ']].') AS body FROM s)"


def links(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("source"), (F.col("id") * 7 % 20).alias("target"), F.when(F.col("id") % 2 == 0, "cite").otherwise("relate").alias("kind"))


def told(df: DataFrame) -> DataFrame:
    lost = F.concat(F.lit("[[Lost "), (F.col("id") % 4).cast("string"), F.lit("]]"))
    return df.withColumn("content", F.concat(F.lit("See [[title "), (F.col("id") * 3 % 130).cast("string"), F.lit("]] and "), lost, F.lit(" "), lost, F.lit(".")))


@query("g_backlinks", SHELF_SQL + LINKS + " SELECT id, title, kind FROM l JOIN s ON s.id = l.source WHERE target = 6 AND NOT deleted")
def g_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return linking.backlinks(links(df), df, 6)


@query("g_unlinked", SHELF_SQL + LINKS + TOLD + ", f AS (SELECT id, title FROM m WHERE NOT deleted AND id <> 6 AND contains(body, 'title 6') ORDER BY updated_minute DESC, id LIMIT 12) SELECT id, title FROM f WHERE id NOT IN (SELECT source FROM l WHERE target = 6)")
def g_unlinked(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return linking.unlinked(told(df), links(df), 6, "title 6", 12)


@query("g_rename", SHELF_SQL + TOLD + " SELECT id, replace(body, '[[Lost 2]]', '[[Found $1]]') AS content FROM m WHERE contains(body, '[[Lost 2]]')")
def g_rename(spark: SparkSession, sf: str) -> DataFrame:
    return linking.renamed(told(shelf(spark, sf)), "lost 2", "Found $1")


@query("g_placeholders", SHELF_SQL + TOLD + ", p AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS title FROM m WHERE NOT deleted) SELECT title, count(*) AS n FROM p WHERE title NOT IN (SELECT title FROM s WHERE NOT deleted) GROUP BY title ORDER BY n DESC, title LIMIT 50")
def g_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return linking.placeholders(told(shelf(spark, sf)))


@query("g_link_upsert", SHELF_SQL + LINKS + " SELECT source, target, kind FROM l UNION SELECT id, id % 20, 'cite' FROM s WHERE id <> id % 20")
def g_link_upsert(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return linking.linked(links(df), df.select(F.col("id").alias("source"), (F.col("id") % 20).alias("target"), F.lit("cite").alias("kind")))


@query("g_graph", SHELF_SQL + LINKS + " SELECT (SELECT count(*) FROM s WHERE NOT deleted) AS nodes, (SELECT count(*) FROM l) AS edges, (SELECT count(DISTINCT title) FROM s WHERE NOT deleted) AS titles")
def g_graph(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    nodes, edges = linking.graph(df, links(df))
    return nodes.agg(F.count("*").alias("nodes"), F.countDistinct("title").alias("titles")).crossJoin(edges.agg(F.count("*").alias("edges")))


@query("g_suggestions", SHELF_SQL + " SELECT id, CASE WHEN contains(title, 'title 1') OR contains('title 1', title) THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS score FROM s WHERE NOT deleted AND id <> 1 ORDER BY score DESC, id LIMIT 30")
def g_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return linking.suggestions(shelf(spark, sf), "Title 1", 1, 30)


# --- changes

MARKED = ", k AS (SELECT *, CASE WHEN deleted THEN created_minute END AS deleted_minute FROM s)"


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("deleted_minute", F.when(F.col("deleted"), F.col("created_minute")))


@query("m_soft_delete", SHELF_SQL + MARKED + " SELECT id, deleted_minute AS before, CAST(77 AS BIGINT) AS after FROM k WHERE id IN (SELECT id * 3 FROM s) AND deleted_minute IS NULL")
def m_soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return changes.soft_delete(stamped(df), df.select((F.col("id") * 3).alias("id")).union(df.select("id").where("id % 3 = 0")), 77)


@query("m_unknown_ids", SHELF_SQL + " SELECT DISTINCT id * 3 AS id FROM s WHERE id * 3 NOT IN (SELECT id FROM s)")
def m_unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return changes.unknown_ids(df.select((F.col("id") * 3).alias("id")), df)


@query("m_log_record", SHELF_SQL + " SELECT 'delete' AS kind, 5 AS at, 'done' AS status, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS ids FROM s WHERE id % 50 = 1 AND id < 10000")
def m_log_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).where("id % 50 = 1 AND id < 10000").select("id")
    return changes.log_record(rows.union(rows), "delete", 5).withColumn("ids", F.array_join("ids", ","))


@query("m_restore_version", SHELF_SQL + " SELECT id, concat('v', id % 3) AS title, substr(content, 1, 10 + id % 3) AS content FROM s WHERE id % 5 = 0")
def m_restore_version(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    versions = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("version"), "content")
    versions = versions.select("id", "version", F.concat(F.lit("v"), "version").alias("title"), F.expr("substring(content, 1, 10 + version)").alias("content"))
    wanted = df.where("id % 5 = 0").select("id", (F.col("id") % 3).cast("int").alias("version"))
    return changes.restored_version(df, versions, wanted)


@query("m_quarantine_plan", SHELF_SQL + ", f AS (SELECT concat('p', id) AS path, file_size AS size, id % 4 = 0 AS r FROM s WHERE id % 3 = 0), t AS (SELECT path, sum(size) OVER (ORDER BY path) AS z FROM (SELECT * FROM f WHERE NOT r ORDER BY path LIMIT 40)) SELECT path, CASE WHEN r THEN 'referenced' WHEN z IS NULL THEN 'too many' WHEN z > 9000 THEN 'too large' ELSE 'move' END AS outcome FROM f LEFT JOIN t USING (path)")
def m_quarantine_plan(spark: SparkSession, sf: str) -> DataFrame:
    files = shelf(spark, sf).where("id % 3 = 0").select(F.concat(F.lit("p"), "id").alias("path"), F.col("file_size").alias("size"), "id")
    return changes.quarantine_plan(files.drop("id"), files.where("id % 4 = 0"), 40, 9000)


@query("m_quarantine_restore", SHELF_SQL + " SELECT concat('p', id) AS path, CASE WHEN id % 5 = 0 THEN 'gone' WHEN id % 3 = 0 THEN 'occupied' ELSE 'restored' END AS outcome FROM s")
def m_quarantine_restore(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    path, stored = F.concat(F.lit("p"), "id"), F.concat(F.lit("q"), "id")
    disk = df.where("id % 3 = 0").select(path.alias("path")).union(df.where("id % 5 <> 0").select(stored.alias("path")))
    return changes.quarantine_restore(df.select(path.alias("path"), stored.alias("stored")), disk)


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


@query("m_set_tags", SHELF_SQL + TAGS_SQL + ", o AS (SELECT id, list(tag) AS t FROM b GROUP BY id) SELECT mode, id, CASE WHEN id % 2 = 1 THEN " + _sorted("t") + " WHEN mode = 'add' THEN " + _sorted("list_concat(t, ['t1', 'x'])") + " WHEN mode = 'remove' THEN " + _sorted("list_filter(t, lambda v: v NOT IN ('t1', 'x'))") + " ELSE 't1,x' END AS tags FROM o, (VALUES ('add'), ('remove'), ('set')) v(mode)")
def m_set_tags(spark: SparkSession, sf: str) -> DataFrame:
    df, out = shelf(spark, sf), None
    wanted = df.where("id % 2 = 0").select("id", F.array(F.lit("x"), F.lit("t1")).alias("tags"))
    for mode in ("add", "remove", "set"):
        rows = changes.set_tags(tags(df), wanted, mode).select(F.lit(mode).alias("mode"), "id", F.array_join("tags", ",").alias("tags"))
        out = rows if out is None else out.union(rows)
    return out


@query("m_insert_checked", SHELF_SQL + ", n AS (SELECT id, concat('c', id % 60) AS name FROM s) SELECT id, CASE WHEN name IN (SELECT concat('c', id) FROM s WHERE id % 4 = 0) OR row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN 'conflict' ELSE 'created' END AS outcome FROM n")
def m_insert_checked(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return changes.insert_checked(df.where("id % 4 = 0").select(F.concat(F.lit("c"), "id").alias("name")), df.select("id", F.concat(F.lit("c"), F.col("id") % 60).alias("name")), "name")


@query("m_hard_delete", SHELF_SQL + " SELECT id FROM s WHERE NOT (id % 10 = 3 AND deleted)")
def m_hard_delete(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return changes.remaining(df, df.where("deleted")).select("id")


# --- search over terms

FIELDS = ("title", "content")


def _merge(terms: list[str], where: str = "TRUE") -> str:
    one = [f"SELECT id, {i} AS term, CASE WHEN contains(title, '{t}') THEN 0 ELSE 1 END AS score FROM s WHERE {where} AND (contains(title, '{t}') OR contains(lower(content), '{t}'))" for i, t in enumerate(terms)]
    return "SELECT id, CAST(count(*) AS INTEGER) AS hit_terms, min(score) AS score, bool_or(score = 0) AS in_title FROM (" + " UNION ALL ".join(one) + ") GROUP BY id"


@query("l_short_term_fill", SHELF_SQL + ", g AS (" + _merge(["title 12"]) + "), h AS (" + _merge(["zz", "!!"], "id NOT IN (SELECT id FROM g)") + ") SELECT * FROM g UNION ALL SELECT * FROM (SELECT * FROM h ORDER BY id LIMIT greatest(0, 60 - (SELECT count(*) FROM g)))")
def l_short_term_fill(spark: SparkSession, sf: str) -> DataFrame:
    return search.routed(shelf(spark, sf), ["title 12", "zz", "!!"], FIELDS, quota=60).select("id", "hit_terms", "score", "in_title")


@query("l_ranked_page", SHELF_SQL + ", g AS (" + _merge(["title 1", "idiot"]) + ") SELECT id, title, hit_terms, score FROM g JOIN s USING (id) ORDER BY hit_terms DESC, score, updated_minute DESC, id LIMIT 20 OFFSET 2")
def l_ranked_page(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return search.ranked(search.routed(df, ["title 1", "idiot"], FIELDS), df, 20, 2).select("id", "title", "hit_terms", "score")


@query("l_found_by_type", SHELF_SQL + ", g AS (" + _merge(["title 1", "idiot"]) + ") SELECT type, count(*) AS n FROM g JOIN s USING (id) GROUP BY type")
def l_found_by_type(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    return search.by_group(search.routed(df, ["title 1", "idiot"], FIELDS), df)


@query("l_index_lag", SHELF_SQL + " SELECT id FROM s WHERE id % 6 = 1")
def l_index_lag(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    index = search.gram_index(df.where("id % 2 = 1"), ("title",))
    index = search.maintained(index, df.select("id", "title", (F.col("id") % 3 == 1).alias("gone")).where("id % 2 = 0 OR id % 3 = 1"), ("title",))
    return search.index_lag(index, df.where("id % 2 = 1 OR id % 3 <> 1"), ("title",))


@query("l_clip", SHELF_SQL + ", t AS (SELECT id, concat('a <mark>', substr(content, 1, 400), '</mark>') AS m FROM s) SELECT id, CASE WHEN length(m) <= 220 THEN m ELSE concat(substr(m, 1, 220), '</mark>…') END AS snippet FROM t WHERE NOT contains(m, chr(10)) OR TRUE")
def l_clip(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("a <mark>"), F.substring("content", 1, 400), F.lit("</mark>"))
    return shelf(spark, sf).select("id", search.clipped(text).alias("snippet"))
