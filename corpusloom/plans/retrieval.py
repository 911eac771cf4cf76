"""Queries over the positional index: ranking, summaries, recall against a scan, ideographs; keywords and snippets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, postings, retrieval
from ..sources.tables import SHELF_SQL, SQL, documents, shelf, table
from ..sources.workspace import exists, shared_dir, version
from .base import query

FIELDS, WEIGHTS = ("title", "content"), [5.0, 1.0]
TERMS = ["thtion", "ering", "with"]


def index_of(spark: SparkSession, sf: str, name: str, df: DataFrame, analyzer: postings.Grams | postings.Runs | None = None) -> postings.Index:
    """The index of this name over the table's present files: built when there is none in the shared folder, then reused."""
    path = f"{shared_dir(spark)}/index-{name}-{hashlib.md5(sf.encode()).hexdigest()[:8]}-{version(spark, f'{sf}/documents.parquet')[:16]}"
    index = postings.Index(spark, path, FIELDS, analyzer=analyzer or postings.Grams())
    return index if exists(spark, f"{path}/size/_SUCCESS") else index.build(df)


def shelf_index(spark: SparkSession, sf: str) -> postings.Index:
    return index_of(spark, sf, "shelf", shelf(spark, sf))


def document_index(spark: SparkSession, sf: str) -> postings.Index:
    return index_of(spark, sf, "documents", documents(spark, sf))


def _bm25(source: str, terms: list[str]) -> str:
    """id, q, w (weighed occurrences), score of one term by row."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f""", f AS (SELECT id, lower(coalesce(content, '')) AS c, lower(title) AS t, length(content) + length(title) AS size FROM {source}),
tf AS (SELECT f.*, q, (length(t) - length(replace(t, q, ''))) // length(q) AS nt, (length(c) - length(replace(c, q, ''))) // length(q) AS nc FROM f, (VALUES {values}) v(q)),
w AS (SELECT *, 5.0 * nt + 1.0 * nc AS w FROM tf WHERE nt + nc > 0), z AS (SELECT count(*) AS n, avg(size) AS a FROM f), df AS (SELECT q, count(*) AS df FROM w GROUP BY q),
sc AS (SELECT id, q, nt, nc, ln(1 + (n - df + 0.5) / (df + 0.5)) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * size / a)) AS score FROM w JOIN df USING (q), z)"""


@query("l_index_build", SQL + ", x AS (SELECT id, regexp_extract_all(lower(content), '(?s).') AS c FROM d), g AS (SELECT id, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS term FROM x WHERE len(c) >= 3), p AS (SELECT id, term, count(*) AS n FROM g GROUP BY id, term) SELECT count(DISTINCT term) AS terms, CAST(sum(n) AS BIGINT) AS places, count(*) AS entries, (SELECT count(*) FROM d) AS documents FROM p")
def l_index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the content's index, read back from its lists."""
    index = document_index(spark, sf)
    lists = spark.read.parquet(f"{index.path}/postings").where("field = 1")
    out = lists.groupBy("term").agg(F.sum(F.size("gaps")).alias("p"), F.sum(F.size("docs")).alias("e")).agg(F.count("*").alias("terms"), F.sum("p").alias("places"), F.sum("e").alias("entries"))
    return out.withColumn("documents", F.lit(index.size()[0]).cast("long"))


@query("l_bm25_topk", """WITH d AS (SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, lang AS language, source AS collection, n_chars FROM documents), f AS (SELECT id, lower(content) AS c, lower(title) AS t, length(content) + length(title) AS size FROM d),
tf AS (SELECT f.*, q, 5.0 * ((length(t) - length(replace(t, q, ''))) // length(q)) + 1.0 * ((length(c) - length(replace(c, q, ''))) // length(q)) AS w FROM f, (VALUES ('thtion'), ('ering'), ('with')) v(q)),
s AS (SELECT count(*) AS n, avg(size) AS a FROM f), df AS (SELECT q, count(*) AS df FROM tf WHERE w > 0 GROUP BY q)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * size / a))), 6) AS score, CAST(count(*) AS INTEGER) AS hit_terms
FROM tf JOIN df USING (q), s WHERE w > 0 GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def l_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = document_index(spark, sf).scored(TERMS, WEIGHTS)
    return best.select("id", F.round("score", 6).alias("score"), "hit_terms").orderBy(F.desc("score"), "id").limit(50)


@query("l_ranked_answer", SHELF_SQL + _bm25("s", ["title 1", "idiot", "worthless"]) + """, g AS (SELECT id, count(*) AS hit_terms, min(CASE WHEN nt > 0 THEN 0 ELSE 1 END) AS field, round(max(score), 6) AS best FROM sc GROUP BY id)
SELECT id, title, CAST(hit_terms AS INTEGER) AS hit_terms, CAST(field AS INTEGER) AS field, best FROM g JOIN s USING (id) WHERE NOT deleted ORDER BY hit_terms DESC, field, best DESC, updated_minute DESC, id LIMIT 25 OFFSET 3""")
def l_ranked_answer(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf).where("NOT deleted")
    rows = retrieval.found(shelf_index(spark, sf), df, ["title 1", "idiot", "worthless"], WEIGHTS)
    rows = postings.page(rows.withColumn("best", F.round("best", 6)), df, 25, 3)
    return rows.select("id", "title", "hit_terms", "field", "best")


@query("l_multi_term_merge", SHELF_SQL + " SELECT id, CAST(count(*) AS INTEGER) AS hit_terms, min(score) AS score, bool_or(score = 0) AS in_title FROM (" + " UNION ALL ".join(
    f"SELECT id, {i} AS term, CASE WHEN contains(title, '{t}') THEN 0 ELSE 1 END AS score FROM s WHERE TRUE AND (contains(title, '{t}') OR contains(lower(content), '{t}'))" for i, t in enumerate(["title 12", "idiot", "worthless"])) + ") GROUP BY id")
def l_multi_term_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf_index(spark, sf).scored(["title 12", "idiot", "Worthless"], WEIGHTS)
    return rows.select("id", "hit_terms", F.col("field").alias("score"), (F.col("field") == 0).alias("in_title"))


_WORDS = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]+'), lambda w: lower(w)) || flatten(list_transform(list_filter(regexp_extract_all({0}, '[一-鿿]+'), lambda r: length(r) > 1), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in retrieval.COMMON) + "))"
_APART = "list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform({0}, lambda c: [c])), lambda acc, c: CASE WHEN len(acc) >= {1} OR len(list_filter(acc, lambda p: contains(p, c[1]) OR contains(c[1], p))) > 0 THEN acc ELSE acc || c END)"


def _ranked_words(source: str) -> str:
    """id, l: distinct words by falling count, ties by word; source has id, t."""
    return f"u AS (SELECT id, unnest({_WORDS.format('t')}) AS w FROM {source}), c AS (SELECT id, w, count(*) AS n FROM u GROUP BY id, w), l AS (SELECT id, list(w ORDER BY n DESC, w) AS l FROM c GROUP BY id)"


@query("t_keywords_apart", SQL + ", e AS (SELECT id, coalesce(content, '') AS t FROM d), " + _ranked_words("e") + f" SELECT e.id, array_to_string(coalesce({_APART.format('l.l', 5)}, []), ' ') AS words FROM e LEFT JOIN l USING (id)")
def t_keywords_apart(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", F.array_join(retrieval.keywords(F.col("content")), " ").alias("words"))


@query("l_answer_summary", SQL + ", h AS (SELECT * FROM d WHERE contains(lower(title), 'ering') OR contains(lower(content), 'ering') OR contains(lower(title), 'zz') OR contains(lower(content), 'zz')), "
       "f AS (SELECT 1 AS id, string_agg(title, ' ' ORDER BY h.id) AS t FROM (SELECT * FROM h ORDER BY id LIMIT 30) h), " + _ranked_words("f") +
       f", a AS (SELECT {_APART.format('l.l', 20)} AS a FROM l), r AS (SELECT list_filter(a, lambda w: NOT (contains(w, 'ering') OR contains('ering', w) OR contains(w, 'zz') OR contains('zz', w)))[1:5] AS r FROM a) "
       "SELECT 'total' AS kind, '' AS value, count(*) AS n FROM h UNION ALL SELECT 'group', language, count(*) FROM h GROUP BY language UNION ALL SELECT 'related', unnest(r), generate_subscripts(r, 1) FROM r")  # fmt: skip
def l_answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    one = retrieval.summary(document_index(spark, sf), documents(spark, sf), ["ering", "zz"], "language")
    total = one.select(F.lit("total").alias("kind"), F.lit("").alias("value"), F.col("total").alias("n"))
    groups = one.select(F.lit("group").alias("kind"), F.explode("by_group").alias("value", "n"))
    related = one.select(F.lit("related").alias("kind"), F.posexplode("related").alias("i", "value")).select("kind", "value", (F.col("i") + 1).cast("long").alias("n"))
    return total.union(groups).union(related)


PROBES = ["the", "with", "ering of", "worthless", "queeuxai", "ausch und", " a ", "..."]


@query("l_index_recall", SQL + ", p(phrase) AS (VALUES " + ", ".join(f"('{p}')" for p in PROBES) + "), t AS (SELECT phrase, count(id) AS n FROM p LEFT JOIN d ON contains(lower(title), phrase) OR contains(lower(content), phrase) GROUP BY phrase) SELECT phrase, n AS truth, n AS found, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(1 AS DOUBLE) AS recall FROM t")
def l_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    return postings.recall(document_index(spark, sf), documents(spark, sf), PROBES)


#: Letters of the tables' texts written as ideographs, so that their words become mixed runs.
LETTERS, IDEOGRAPHS = "etaoinsrhldu", "中文字检索词库本书目录页"
RUNS = ["中文", "检词", "书中", "文书中", "索词", "库本书目录", "页"]


@query("l_ideograph_phrases", SQL + f", m AS (SELECT id, translate(lower(title), '{LETTERS}', '{IDEOGRAPHS}') AS t, translate(lower(content), '{LETTERS}', '{IDEOGRAPHS}') AS c FROM d), p(phrase) AS (VALUES " + ", ".join(f"('{p}')" for p in RUNS) + ") SELECT id, phrase, (length(t) - length(replace(t, phrase, ''))) // length(phrase) + (length(c) - length(replace(c, phrase, ''))) // length(phrase) AS n FROM m, p WHERE contains(t, phrase) OR contains(c, phrase)")
def l_ideograph_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of phrases without blanks, from the lists of single and paired ideographs."""
    df = documents(spark, sf).select("id", *[F.translate(F.lower(c), LETTERS, IDEOGRAPHS).alias(c) for c in FIELDS])
    rows = index_of(spark, sf, "ideographs", df, postings.Runs()).matches(RUNS)
    each = rows.select("id", F.posexplode("tf").alias("p", "tf")).select("id", F.array(*map(F.lit, RUNS))[F.col("p")].alias("phrase"), F.aggregate("tf", F.lit(0), lambda s, x: s + x).cast("long").alias("n"))
    return each.where("n > 0")


@query("l_snippet_terms", SQL + r""", x AS (SELECT id, trim(regexp_replace(coalesce(content, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS f FROM d),
p AS (SELECT id, f, v.i, v.q, instr(lower(f), v.q) AS pos FROM x, (VALUES (0, 'worthless'), (1, 'idiot'), (2, 'buy')) v(i, q)), b AS (SELECT id, min({'s': greatest(1, pos - 26), 'i': i, 'pos': pos, 'n': length(q)}) AS b FROM p WHERE pos > 0 GROUP BY id),
e AS (SELECT x.id, f, b.s AS s, b.pos AS pos, b.n AS n, least(length(f), b.pos + b.n + 79) AS e FROM x JOIN b USING (id)),
m AS (SELECT id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(f, s, pos - s) || '<mark>' || substr(f, pos, n) || '</mark>' || substr(f, pos + n, e - pos - n + 1) || CASE WHEN e < length(f) THEN '…' ELSE '' END AS m FROM e)
SELECT id, m AS snippet FROM m""")
def l_snippet_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = ["worthless", "idiot", "buy"]
    df = documents(spark, sf).select("id", T.collapsed("content").alias("t"))
    holds = F.lower("t").rlike("worthless|idiot|buy")
    return df.where(holds).select("id", retrieval.snippet(F.col("t"), terms).alias("snippet"))


@query("j_containment", SQL + " SELECT id AS source, item_id AS target FROM d JOIN benchmark ON contains(content, benchmark.text)")
def j_containment(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"))
    df = documents(spark, sf)
    return postings.containing(document_index(spark, sf), df, titles).unionByName(graph.contained(df, titles.where("length(title) = 2")))
