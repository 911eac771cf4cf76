"""All queries: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, changes, graph, listing, review, search, vectors
from ..sources.tables import SQL, documents, table
from ..sources.workspace import once
from ..streaming import state
from .base import REGISTRY, query  # noqa: F401

RULES = [("prices", ["worthless", "$$$"]), ("ads", ["buy", "!!"]), ("forms", [" | ", "###"]), ("people", ["idiot", "moron", "clown"]), ("plain", ["the", "der", "les"])]


# --- filters and lists


@query("f_text_contains", SQL + " SELECT id, title FROM d WHERE contains(lower(coalesce(content, '')), 'idiot') OR contains(lower(title), 'idiot')")
def f_text_contains(spark: SparkSession, sf: str) -> DataFrame:
    return listing.apply_filters(documents(spark, sf), listing.FilterSpec(text="Idiot")).select("id", "title")


@query("f_scope_list", SQL + " SELECT id, title, n_chars FROM d WHERE collection IN ('src1', 'src2') AND language = 'en'")
def f_scope_list(spark: SparkSession, sf: str) -> DataFrame:
    spec = listing.FilterSpec(collections=("src1", "src2"), language="ENG")
    return listing.apply_filters(documents(spark, sf), spec).select("id", "title", "n_chars")


@query("f_status_bucket", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'unread' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'reading' END AS status FROM orders")
def f_status_bucket(spark: SparkSession, sf: str) -> DataFrame:
    progress = F.when(F.col("o_orderstatus") == "O", 0.0).when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5)
    return table(spark, sf, "orders").select("o_orderkey", listing.status_bucket(progress).alias("status"))


@query("f_tag_semi", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7)")
def f_tag_semi(spark: SparkSession, sf: str) -> DataFrame:
    tagged = table(spark, sf, "lineitem").join(table(spark, sf, "part").where("p_size = 7"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf, "orders")
    return orders.join(tagged, orders["o_orderkey"] == tagged["l_orderkey"], "left_semi").select("o_orderkey", "o_orderstatus")


@query("f_quality_issues_or", SQL + " SELECT id FROM d WHERE length(trim(coalesce(content, ''))) < 500")
def f_quality_issues_or(spark: SparkSession, sf: str) -> DataFrame:
    return listing.apply_filters(documents(spark, sf), listing.FilterSpec(quality="issues")).select("id")


@query("f_preview_200", SQL + r", f AS (SELECT id, trim(regexp_replace(substr(content, 1, 800), '\s+', ' ', 'g')) AS t FROM d) SELECT id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS preview FROM f")
def f_preview_200(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", T.preview(F.col("content")).alias("preview"))


@query("o_sort_stable_page", SQL + " SELECT id, title, n_chars FROM d ORDER BY n_chars DESC, id LIMIT 50 OFFSET 20")
def o_sort_stable_page(spark: SparkSession, sf: str) -> DataFrame:
    return listing.page(documents(spark, sf).select("id", "title", "n_chars"), [F.desc("n_chars"), F.asc("id")], 50, 20)


@query("o_ids_truncated", SQL + ", f AS (SELECT id FROM d WHERE language = 'en') SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 100 AS truncated FROM f ORDER BY id LIMIT 100")
def o_ids_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return listing.ids_with_total(listing.apply_filters(documents(spark, sf), listing.FilterSpec(language="en")), cap=100)


# --- aggregates


@query("a_shelf_stats", SQL + " SELECT collection, count(*) AS n, count(*) FILTER (length(trim(content)) < 500) AS short, count(DISTINCT language) AS languages, max(n_chars) AS longest FROM d GROUP BY collection")
def a_shelf_stats(spark: SparkSession, sf: str) -> DataFrame:
    short = F.length(F.trim("content")) < 500
    return documents(spark, sf).groupBy("collection").agg(F.count("*").alias("n"), F.count_if(short).alias("short"), F.countDistinct("language").alias("languages"), F.max("n_chars").alias("longest"))


@query("a_facets_self_excluding", SQL + """, f AS (
 SELECT 'collection' AS dimension, collection AS value, count(*) AS n FROM d WHERE language = 'en' GROUP BY collection
 UNION ALL SELECT 'language', language, count(*) FROM d WHERE collection IN ('src1', 'src2', 'src3') GROUP BY language)
SELECT dimension, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM f) WHERE r <= 100""")
def a_facets_self_excluding(spark: SparkSession, sf: str) -> DataFrame:
    spec = listing.FilterSpec(collections=("src1", "src2", "src3"), language="en")
    return listing.facets(documents(spark, sf), spec, ("collection", "language"))


@query("a_facet_distinct_fanout", "SELECT p_brand AS value, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def a_facet_distinct_fanout(spark: SparkSession, sf: str) -> DataFrame:
    bridge = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("value"))
    return bridge.join(tags, "l_partkey").groupBy("value").agg(F.countDistinct("l_orderkey").alias("n"))


@query("a_top_authors", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 30")
def a_top_authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(30)


@query("a_minutes_by_day", "SELECT CAST(ts AS DATE) AS day, round(sum(greatest(0, value / 60)), 1) AS minutes FROM events GROUP BY day")
def a_minutes_by_day(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("value") / 60)), 1).alias("minutes"))


@query("a_heatmap_dense", "WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY day) SELECT CAST(x AS DATE) AS day, coalesce(n, 0) AS n FROM generate_series(DATE '2023-12-01', DATE '2024-11-29', INTERVAL 1 DAY) t(x) LEFT JOIN c ON c.day = CAST(x AS DATE)")
def a_heatmap_dense(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return review.dense_days(by, "day", "n", F.lit("2023-12-01").cast("date"), F.lit("2024-11-29").cast("date"))


@query("a_having_dups", SQL + " SELECT sha256(content) AS sha256, count(*) AS n, min(id) AS first_id FROM d GROUP BY content HAVING count(*) > 1")
def a_having_dups(spark: SparkSession, sf: str) -> DataFrame:
    hashed = documents(spark, sf).select("id", F.sha2("content", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("a_listagg_titles", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS titles FROM nation GROUP BY n_regionkey")
def a_listagg_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("titles"))


@query("a_median_latency", "SELECT event_type, round(median(value), 4) AS median, round(quantile_disc(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def a_median_latency(spark: SparkSession, sf: str) -> DataFrame:
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median"), F.round(p95, 4).alias("p95"))


@query("a_length_histogram", SQL + " SELECT count(*) FILTER (length(trim(content)) = 0) AS empty, count(*) FILTER (length(trim(content)) BETWEEN 1 AND 499) AS short, count(*) FILTER (length(trim(content)) >= 500) AS full_text, count(*) AS total FROM d")
def a_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length(F.trim("content"))
    return documents(spark, sf).agg(F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 500)).alias("short"), F.count_if(n >= 500).alias("full_text"), F.count("*").alias("total"))


# --- joins


@query("j_three_way", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j_three_way(spark: SparkSession, sf: str) -> DataFrame:
    # joined on keys first, so that only one row a customer meets the names
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    named = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = by.join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name")
    return out.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("j_left_snapshot", SQL + " SELECT id, quality, quality IS NULL AS not_audited FROM d LEFT JOIN labels ON id = doc_id")
def j_left_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    return d.select("id", "quality", F.col("quality").isNull().alias("not_audited"))


@query("j_anti_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j_anti_orphans(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    ends = edges.select(F.col("target").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(ends, "c_custkey", "left_anti")


@query("j_recon_two_sided", "SELECT l_partkey AS path, 'orphan' AS state FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 45) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT p_partkey, 'missing' FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def j_recon_two_sided(spark: SparkSession, sf: str) -> DataFrame:
    disk = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("path"))
    return changes.reconcile(disk, table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("path")))


# --- windows and versions


@query("w_keep_best", SQL + ", r AS (SELECT id, content, row_number() OVER (PARTITION BY content ORDER BY length(title) DESC, id) AS n FROM d) SELECT id FROM r WHERE n = 1")
def w_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("id", F.sha2("content", 256).alias("h"), F.length("title").alias("t"))
    return changes.keep_newest(d, "h", [F.desc("t"), F.asc("id")], 1).select("id")


@query("w_keep_last_n", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def w_keep_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return changes.keep_newest(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 2)


@query("w_greedy_thinning", """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
k AS (SELECT user_id, n, ts, ts AS kept, TRUE AS keep FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.ts, CASE WHEN epoch_us(e.ts) - epoch_us(k.kept) >= 21600000000 THEN e.ts ELSE k.kept END, epoch_us(e.ts) - epoch_us(k.kept) >= 21600000000 FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT user_id, count(*) AS kept FROM k WHERE keep GROUP BY user_id""")
def w_greedy_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return changes.thinned(table(spark, sf, "events"), "user_id", "ts", 6 * 3600).groupBy("user_id").agg(F.count("*").alias("kept"))


# --- search


@query("l_substring_rank", SQL + " SELECT id, CASE WHEN contains(lower(title), 'of the') THEN 0 WHEN contains(lower(content), 'of the') THEN 1 END AS field FROM d WHERE contains(lower(content), 'of the') OR contains(lower(title), 'of the')")
def l_substring_rank(spark: SparkSession, sf: str) -> DataFrame:
    rank = search.field_rank("of the", ("title", "content"))
    return documents(spark, sf).select("id", rank.alias("field")).where("field < 2")


@query("l_trigram_postings", SQL + ", g AS (SELECT id, unnest(list_transform(range(1, greatest(length(title) - 1, 1)), lambda i: substr(lower(title), i, 3))) AS gram FROM d WHERE length(title) >= 3) SELECT gram, count(DISTINCT id) AS df, count(*) AS cf FROM g GROUP BY gram")
def l_trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(documents(spark, sf), "title").groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("l_window_480", SQL + " SELECT id, substr(content, greatest(1, instr(lower(content), 'worthless') - 60), 480) AS w FROM d WHERE contains(lower(content), 'worthless')")
def l_window_480(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", T.window(F.col("content"), "worthless").alias("w")).where("w IS NOT NULL")


@query("l_snippet_mark", SQL + """, f AS (SELECT id, content, instr(lower(content), 'idiot') AS a FROM d WHERE contains(lower(content), 'idiot')), g AS (SELECT *, greatest(1, a - 30) AS s FROM f)
SELECT id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(content, s, a - s) || '<mark>' || substr(content, a, 5) || '</mark>' || substr(content, a + 5, 30) || CASE WHEN length(content) > a + 34 THEN '…' ELSE '' END AS snippet FROM g""")
def l_snippet_mark(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", T.marked(F.col("content"), "idiot").alias("snippet")).where("snippet IS NOT NULL")


@query("l_summary_by_source", SQL + " SELECT collection, count(*) AS n FROM d WHERE contains(lower(content), 'the') GROUP BY collection")
def l_summary_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(T.contains(F.col("content"), "the")).groupBy("collection").agg(F.count("*").alias("n"))


@query("l_fuzzy_subsequence")
def l_fuzzy_subsequence(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", search.fuzzy_score(F.col("title"), "thin").alias("score")).where("score IS NOT NULL")


# --- vectors


@query("v_topk_dot", """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * v[i])) AS score FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def v_topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.exact_top(e, e.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "rank")


@query("v_precision_at_5", """WITH q AS (SELECT vec_id AS query_id, embedding AS v, label AS own FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label = own AS same, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * v[i])) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, count(*) FILTER (same) AS hits, count(*) FILTER (same) / 5.0::DOUBLE AS precision FROM r WHERE n <= 5 GROUP BY query_id""")
def v_precision_at_5(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    ranked = once(vectors.exact_top(e, e.where("vec_id % 50 = 0"), 5).withColumnRenamed("vec_id", "item"))  # read twice
    labels = e.select(F.col("vec_id").alias("item"), "label")
    own = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = ranked.select("query_id", "item").join(own, "query_id").join(labels, ["item", "label"]).select("query_id", "item")
    return vectors.precision(ranked, same, 5)


@query("v_rrf", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), u AS (SELECT * FROM a WHERE r <= 100 UNION ALL SELECT * FROM b WHERE r <= 100) SELECT 1 AS query_id, doc_id AS item, round(sum(1.0 / (60 + r)), 9) AS rrf FROM u GROUP BY doc_id")
def v_rrf(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lists = [d.orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank")), d.orderBy("doc_id").limit(100).select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("rank"))]
    both = lists[0].union(lists[1]).select(F.lit(1).alias("query_id"), F.col("doc_id").alias("item"), "rank")
    return vectors.fuse(both).select("query_id", "item", F.round("rrf", 9).alias("rrf"))


@query("v_chunk_estimate", SQL + " SELECT id, least(CAST(ceil(length(content) / 680.0) AS BIGINT), 200) AS chunks FROM d")
def v_chunk_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", vectors.chunk_count(F.length("content")).alias("chunks"))


@query("v_chunks", SQL + ", n AS (SELECT id, content, greatest(0, CAST(ceil((length(content) - 120) / 680.0) AS INTEGER) - 1) AS k FROM d WHERE length(content) >= 200), s AS (SELECT id, content, unnest(range(0, k + 1)) AS i FROM n) SELECT id, CAST(i AS INTEGER) AS idx, md5(substr(content, i * 680 + 1, 800)) AS chunk_md5 FROM s")
def v_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.chunks(documents(spark, sf)).select("id", "idx", F.md5("chunk").alias("chunk_md5"))


# --- quality


@query("q_audit_issues", SQL + """, f AS (SELECT id, length(trim(content)) AS n, count(*) OVER (PARTITION BY content) AS c FROM d)
SELECT issue, count(*) AS n FROM (SELECT unnest(CASE WHEN len(i) = 0 THEN ['clean'] ELSE i END) AS issue FROM (SELECT list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n BETWEEN 1 AND 499 THEN 'short' END, CASE WHEN c > 1 AND n > 0 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS i FROM f)) GROUP BY issue""")
def q_audit_issues(spark: SparkSession, sf: str) -> DataFrame:
    return audit.issue_counts(audit.audit(documents(spark, sf)))


@query("q_dedup_plan", SQL + ", g AS (SELECT id, content, count(*) OVER (PARTITION BY content) AS c, row_number() OVER (PARTITION BY content ORDER BY n_chars DESC, id) AS n, first_value(id) OVER (PARTITION BY content ORDER BY n_chars DESC, id) AS keeper FROM d) SELECT id, sha256(content) AS sha256, CASE WHEN octet_length(encode(content)) <= 1024 THEN 'suspicious' WHEN n = 1 THEN 'keep' ELSE 'delete' END AS action, keeper FROM g WHERE c > 1")
def q_dedup_plan(spark: SparkSession, sf: str) -> DataFrame:
    return audit.dedup_plan(documents(spark, sf), [F.desc("n_chars"), F.asc("id")])


@query("q_lang_plan", SQL + " SELECT language AS from_code, language AS to_code, count(*) AS n FROM d GROUP BY language")
def q_lang_plan(spark: SparkSession, sf: str) -> DataFrame:
    return audit.language_plan(documents(spark, sf))


@query("q_classify_rules", SQL + " SELECT id, CASE WHEN contains(lower(content), 'worthless') OR contains(content, '$$$') THEN 'prices' WHEN contains(lower(content), 'buy') OR contains(content, '!!') THEN 'ads' WHEN contains(content, ' | ') OR contains(content, '###') THEN 'forms' WHEN regexp_matches(lower(content), 'idiot|moron|clown') THEN 'people' WHEN regexp_matches(lower(content), 'the|der|les') THEN 'plain' END AS category FROM d")
def q_classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", audit.classify_by_rules(F.col("content"), RULES).alias("category"))


_SCORES = ", ".join("{'n': " + " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{w}', ''))) // {len(w)} * {2 * len(w) if len(w) > 2 else 1}" for w in words if len(w) > 1) + f", 'i': {i}, 'c': '{name}'}}" for i, (name, words) in enumerate(RULES))


@query("q_classify_scored", SQL + f", r AS (SELECT id, list_sort(list_transform([{_SCORES}], lambda e: {{'m': -e.n, 'i': e.i, 'c': e.c}})) AS r FROM d) SELECT id, CASE WHEN -r[1].m >= 4 AND -r[1].m >= 1.5 * -r[2].m THEN r[1].c END AS category FROM r")
def q_classify_scored(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", audit.classify_by_score(F.col("content"), RULES).alias("category"))


# --- text and graph


@query("t_keywords", SQL + ", w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z]{2,}')) AS word FROM d), c AS (SELECT id, word, count(*) AS n FROM w WHERE word NOT IN (" + ", ".join(f"'{x}'" for x in sorted(search.STOPWORDS)) + ") GROUP BY id, word), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS nth FROM c) SELECT id, word, n, nth FROM r WHERE nth <= 5")
def t_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return graph.keywords(documents(spark, sf))


@query("t_summary", SQL + r", f AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '[.!?。！？\n]+'), lambda x: trim(x)), lambda x: length(x) >= 8)[1] AS s FROM d) SELECT id, CASE WHEN length(s) > 100 THEN substr(s, 1, 100) || '…' ELSE s END AS summary FROM f")
def t_summary(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", T.summary(F.col("content")).alias("summary"))


@query("g_links_from_pages", "SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id")
def g_links_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("u")
    return table(spark, sf, "pages").select("page_id", found).groupBy("page_id").agg(F.count("*").alias("links"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_quantity >= 49")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).distinct()


_E = "WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem WHERE l_quantity >= 49)"


@query("g_degree", _E + " SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node")
def g_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(_edges(spark, sf))


@query("g_khop", _E + ", w AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), r AS (SELECT 's1' AS node, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN w ON a = node WHERE hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY node")
def g_khop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf), spark.createDataFrame([("s1",)], "node string"), 2)


@query("g_ancestors", "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS ancestor, 1 AS distance FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def g_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return graph.ancestors(n.union(s), depth=4)


# --- review and activity

_RATE = {"error": 1, "view": 2, "click": 3, "signup": 3, "purchase": 4}


@query("r_sm2_fold", """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS i, CAST(2.5 AS DOUBLE) AS ease, 0 AS reps, 0 AS lapses FROM e WHERE n = 1
 UNION ALL SELECT f.user_id, e.n,
  CASE WHEN r = 1 THEN 0.0::DOUBLE WHEN r = 3 AND reps = 0 THEN 1 WHEN r = 3 AND reps = 1 THEN 3 WHEN r = 4 AND reps = 0 THEN 4
   ELSE least(2900000, greatest(1, trunc(CASE r WHEN 2 THEN i * 1.2::DOUBLE WHEN 3 THEN i * ease ELSE i * ease * 1.3::DOUBLE END))) END,
  least(2.8::DOUBLE, greatest(1.3::DOUBLE, ease + CASE r WHEN 1 THEN -0.2::DOUBLE WHEN 2 THEN -0.15::DOUBLE WHEN 4 THEN 0.15::DOUBLE ELSE 0 END)),
  CASE WHEN r = 1 THEN 0 ELSE reps + 1 END, lapses + CASE WHEN r = 1 THEN 1 ELSE 0 END
 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, CAST(i AS INTEGER) AS interval, reps, lapses, round(ease, 6) AS ease FROM f WHERE n = (SELECT max(n) FROM e WHERE e.user_id = f.user_id)""")
def r_sm2_fold(spark: SparkSession, sf: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(3)
    rated = table(spark, sf, "events").select("user_id", "ts", "event_id", rating.alias("rating"))
    return review.fold_ratings(rated, "user_id", ["ts", "event_id"], "rating").select("user_id", "interval", "reps", "lapses", F.round("ease", 6).alias("ease"))


@query("r_stats_tz", "SELECT CAST(ts + INTERVAL 480 MINUTE AS DATE) AS day, count(*) AS n FROM events GROUP BY day")
def r_stats_tz(spark: SparkSession, sf: str) -> DataFrame:
    return review.local_day_counts(table(spark, sf, "events"), "ts", 480)


@query("r_due_two_tier", "(SELECT event_id, 0 AS tier FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 20) UNION ALL (SELECT event_id, 1 FROM events WHERE event_type <> 'view' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50)")
def r_due_two_tier(spark: SparkSession, sf: str) -> DataFrame:
    interval = F.when(F.col("event_type") == "view", 0).otherwise(1)
    cards = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("active").alias("status"), F.col("ts").alias("due_at"), F.col("ts").alias("created_at"), interval.alias("interval_days"))
    return review.due(cards, F.lit("2024-01-20").cast("timestamp_ntz"), 20, 50).select(F.col("id").alias("event_id"), "tier")


# --- changes, sinks, state


@query("m_batch_before_after", "SELECT c_custkey, c_mktsegment AS before_segment, 'HOUSEHOLD' AS after_segment FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment <> 'HOUSEHOLD'")
def m_batch_before_after(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    batch = c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("HOUSEHOLD").alias("c_mktsegment"))
    log = changes.patch(c, batch, "c_custkey", ["c_mktsegment"])
    return log.select("c_custkey", F.col("before.c_mktsegment").alias("before_segment"), F.col("after.c_mktsegment").alias("after_segment"))


@query("m_undo_conditional", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed since' ELSE 'undone' END AS outcome, CASE WHEN c_custkey % 3 = 0 THEN 'EDITED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment <> 'HOUSEHOLD'")
def m_undo_conditional(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    log = changes.patch(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("HOUSEHOLD").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])
    now = log.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "EDITED").otherwise(F.col("after.c_mktsegment")).alias("c_mktsegment"))
    back = changes.undo(now, log, "c_custkey", ["c_mktsegment"])
    return back.select("c_custkey", "outcome", F.col("values.c_mktsegment").alias("segment"))


@query("s_backup_plan", "WITH l AS (SELECT p_partkey AS path, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 11 <> 0), m AS (SELECT p_partkey AS path, p_size AS size FROM part WHERE p_partkey % 13 <> 0) SELECT path, CASE WHEN l.size IS NULL THEN 'drop' WHEN m.size IS NULL THEN 'new' WHEN l.size <> m.size THEN 'changed' ELSE 'unchanged' END AS action FROM l FULL JOIN m USING (path)")
def s_backup_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.lit(0).alias("mtime"))
    now = p.where("path % 11 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 5 == 0, 1).otherwise(0))
    return changes.backup_plan(now, p.where("path % 13 <> 0"))


@query("s_tsv_export", "SELECT conv_id || chr(9) || turn || chr(9) || replace(replace(replace(text, chr(9), ' '), chr(13), ''), chr(10), ' ') AS line FROM conversations")
def s_tsv_export(spark: SparkSession, sf: str) -> DataFrame:
    return changes.tsv_lines(table(spark, sf, "conversations"), ["conv_id", "turn", "text"])


@query("s_restore_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept ' || s_name ELSE s_name END AS s_name FROM supplier")
def s_restore_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    backup = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("kept "), "s_name").alias("s_name"))
    return changes.restore(s, backup, "s_suppkey")


@query("z_rate_limit")
def z_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    calls = state.limited(table(spark, sf, "events"), ["user_id"], "ts", 5, 24 * 3600)
    return calls.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("calls"))


@query("z_arrival_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def z_arrival_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return state.arrivals(d, "digest", "doc_id").select("doc_id")


@query("z_session_minutes", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def z_session_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return state.sessions(table(spark, sf, "events"), "user_id", "ts")


from . import history, intake, measures, notes, reports, retrieval, shelf, upkeep  # noqa: E402, F401
