"""Lexical search: query terms, trigram postings, BM25 of phrases, snippets, fuzzy scores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
#: Words that carry no search intent.
STOPWORDS = set("a an and are as at be by do does for from how in is it of on or that the this to was what when where which who why with".split())


def query_terms(query: str, most: int = 6) -> list[str]:
    """At most `most` terms of a query: words without stop words and repeats (case-insensitive), in their order."""
    out: dict[str, str] = {}
    for w in re.findall(r"\w+", query):
        if w.lower() not in STOPWORDS and len(w) > 1:
            out.setdefault(w.lower(), w)
    return list(out.values())[:most]


def trigrams(c: Column, n: int = 3) -> Column:
    """All n-grams of the lower-cased text, repeats included."""
    low = F.lower(c)
    chars = F.split(low, "")  # once a row: substring() would count from the start for every gram
    count = F.length(low) - (n - 1)
    grams = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1)), lambda i: F.concat(*[x[i + k] for k in range(n)]))
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.element_at(F.transform(F.array(chars), grams), 1))


def postings(df: DataFrame, column: str, key: str = "id", n: int = 3) -> DataFrame:
    """gram, key, tf: the inverted index of one column; counts are summed in each task before anything is shuffled."""
    grams = F.explode(trigrams(F.coalesce(column, F.lit("")), n)).alias("gram")
    return df.select(key, grams).groupBy("gram", key).agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, terms: list[str], weights: dict[str, float], key: str = "id") -> DataFrame:
    """df plus score double and hit_terms int for rows with a match; higher is better.

    A term is a phrase: its occurrences in a column weigh `weights[column]`. Lengths and document frequencies come from
    one aggregate row, broadcast; so two narrow scans and no shuffle of documents.
    """
    tf = {(c, t): T.occurrences(F.lower(F.coalesce(c, F.lit(""))), t.lower()) for c in weights for t in terms}
    names = {k: f"_tf{i}" for i, k in enumerate(tf)}
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in weights), F.lit(0))
    counted = df.withColumns({names[k]: v for k, v in tf.items()} | {"_size": size})
    hit = {t: reduce(Column.__or__, [F.col(names[c, t]) > 0 for c in weights]) for t in terms}
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_size").alias("_avg"), *[F.count_if(hit[t]).alias(f"_df{i}") for i, t in enumerate(terms)])
    both = counted.where(reduce(Column.__or__, hit.values())).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("_size") / F.col("_avg"))
    parts = []
    for i, t in enumerate(terms):
        weighed = sum((F.col(names[c, t]) * w for c, w in weights.items()), F.lit(0.0))
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        parts.append(idf * weighed * (K1 + 1) / (weighed + norm))
    hits = sum((hit[t].cast("int") for t in terms), F.lit(0))
    out = both.withColumns({"score": sum(parts, F.lit(0.0)), "hit_terms": hits})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def field_rank(term: str, columns: tuple[str, ...]) -> Column:
    """Place of the first column that contains the term, one more than the last if none does."""
    out = None
    for i, c in enumerate(columns):
        out = F.when(T.contains(F.col(c), term), i) if out is None else out.when(T.contains(F.col(c), term), i)
    return out.otherwise(len(columns))


def fuzzy_score(c: Column, query: str) -> Column:
    """Subsequence score: each query character in order: 1, or 2 right after the last one (or at the start), 4 from the
    second such one on, less 0.01 a character of the text; null if the query is no subsequence. The empty query has 1."""
    low = F.lower(c)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("streak"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(s: Column, q: Column) -> Column:
        rest = F.substring(low, s["at"] + 1, F.length(low))
        i = F.position(q, rest)
        streak = F.when(i == 1, s["streak"] + 1).otherwise(F.lit(0))
        gain = F.when(streak >= 2, 4.0).when(streak == 1, 2.0).otherwise(1.0)
        return F.struct((s["at"] + i).alias("at"), streak.alias("streak"), (s["score"] + gain).alias("score"), (s["ok"] & (i > 0)).alias("ok"))

    if not query:
        return F.when(c.isNotNull(), F.lit(1.0))
    chars = F.array(*[F.lit(x) for x in query.lower()])
    return F.aggregate(chars, start, step, lambda s: F.when(s["ok"], s["score"] - 0.01 * F.length(low)))


def recall_windows(term: str, most: int = 6) -> list[str]:
    """Windows of four, then of three characters of a term of five or more without spaces between its words."""
    if len(term) < 5 or term.isascii():
        return []
    return list(dict.fromkeys(term[i : i + n] for n in (4, 3) for i in range(len(term) - n + 1)))[:most]


def indexed(index: DataFrame, df: DataFrame, term: str, columns: tuple[str, ...], key: str = "id", n: int = 3) -> DataFrame:
    """Rows of df that hold a term of n or more characters: ids with all its grams from the index, then the rows are looked at.

    index: gram, key, over the same columns. Only its postings of the term's grams are read, and only the rows found.
    """
    low = term.lower()
    grams = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
    ids = index.where(F.col("gram").isin(*grams)).select("gram", key).distinct().groupBy(key).agg(F.count("*").alias("_g")).where(F.col("_g") == len(grams)).select(key)
    return df.join(ids, key, "left_semi").where(field_rank(term, columns) < len(columns))


def gram_index(df: DataFrame, columns: tuple[str, ...], key: str = "id", n: int = 3) -> DataFrame:
    """gram, key over several columns; distinct in each row before anything is shuffled, so write it once and reuse it."""
    every = F.array_distinct(F.flatten(F.array(*[trigrams(F.coalesce(c, F.lit("")), n) for c in columns])))
    return df.select(key, F.explode(every).alias("gram"))


def maintained(index: DataFrame, changed: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """The index after changes (key, columns, gone boolean): postings of changed rows go, those of rows still there come."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(gram_index(changed.where(~F.col("gone")), columns, key))


def index_lag(index: DataFrame, df: DataFrame, columns: tuple[str, ...], key: str = "id", n: int = 3) -> DataFrame:
    """key: rows with a gram that the index doesn't hold at all, and rows of the index that are gone; rebuild if there are any."""
    size = sum((F.greatest(F.length(F.coalesce(c, F.lit(""))) - (n - 1), F.lit(0)) for c in columns), F.lit(0))
    there, want = index.select(key).distinct(), df.where(size > 0).select(key)
    return want.join(there, key, "left_anti").union(there.join(want, key, "left_anti"))


def routed(df: DataFrame, terms: list[str], columns: tuple[str, ...], index: DataFrame | None = None, quota: int = 200, key: str = "id") -> DataFrame:
    """key, hit_terms, score, in_title, window: rows that hold any of the terms, merged over the terms.

    Terms of three or more characters go through the index (without one: a scan), shorter ones are searched as substrings
    and only fill up what is left of `quota`, by key. score is the best column's place, in_title whether any term stands in
    the first column, window that of the first term that hits.
    """

    def hits(rows: DataFrame, i: int, term: str) -> DataFrame:
        rank = field_rank(term, columns)
        text = F.coalesce(*[T.window(F.col(c), term) for c in reversed(columns)])
        return rows.where(rank < len(columns)).select(key, F.lit(i).alias("term"), rank.alias("score"), (rank == 0).alias("in_title"), text.alias("window"))

    def merged(parts: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy(key).agg(F.count("*").cast("int").alias("hit_terms"), F.min("score").alias("score"), F.max("in_title").alias("in_title"), F.min_by("window", "term").alias("window"))

    long = [(i, t) for i, t in enumerate(terms) if len(t) >= 3]
    short = [(i, t) for i, t in enumerate(terms) if len(t) < 3]
    found = merged([hits(indexed(index, df, t, columns, key) if index is not None else df, i, t) for i, t in long]) if long else None
    if not short:
        return found
    left = df if found is None else df.join(found.select(key), key, "left_anti")
    fill = merged([hits(left, i, t) for i, t in short])
    if found is None:
        return fill.orderBy(key).limit(quota)
    room = found.agg(F.greatest(F.lit(0), F.lit(quota) - F.count("*")).alias("_room"))
    nth = F.row_number().over(Window.orderBy(key))  # over at most `quota` rows
    fill = fill.orderBy(key).limit(quota).withColumn("_n", nth).crossJoin(room).where(F.col("_n") <= F.col("_room")).drop("_n", "_room")
    return found.unionByName(fill)


def ranked(found: DataFrame, df: DataFrame, limit: int = 20, offset: int = 0, key: str = "id") -> DataFrame:
    """The page of found rows: most terms, best column, newest, key; titles are joined to that page alone."""
    newest = found.join(df.select(key, "updated_minute"), key)
    page = newest.orderBy(F.desc("hit_terms"), "score", F.desc("updated_minute"), key).offset(offset).limit(limit)
    return page.join(df.select(key, "title"), key)


def recalled(df: DataFrame, terms: list[str], columns: tuple[str, ...], index: DataFrame | None = None) -> DataFrame:
    """routed(); where it finds nothing, the windows of the terms instead (one look whether there is a row)."""
    found = routed(df, terms, columns, index)
    windows = [w for t in terms for w in recall_windows(t)][:6]
    return routed(df, windows, columns, index) if windows and found.isEmpty() else found


def clipped(marked: Column, most: int = 220) -> Column:
    """A snippet cut at `most` characters, an open mark closed, an ellipsis at the end."""
    head = F.substring(marked, 1, most)
    open_ = T.occurrences(head, "<mark>") > T.occurrences(head, "</mark>")
    return F.when(F.length(marked) <= most, marked).otherwise(F.concat(head, F.when(open_, "</mark>").otherwise(""), F.lit("…")))


def by_group(found: DataFrame, df: DataFrame, group: str = "type", key: str = "id") -> DataFrame:
    """group, n of the rows found."""
    return found.select(key).join(df.select(key, group), key).groupBy(group).agg(F.count("*").alias("n"))


def in_annotations(annotations: DataFrame, df: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """id, document_id, title: annotations of live documents whose quote or note holds the text, newest first."""
    hit = T.contains(F.col("quote"), text) | T.contains(F.col("note"), text)
    rows = annotations.where(hit).join(df.where(~F.col("deleted")).select(F.col("id").alias("document_id"), "title"), "document_id")
    return rows.orderBy(F.desc("created_minute"), F.desc("id")).limit(limit).select("id", "document_id", "title")
