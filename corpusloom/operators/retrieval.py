"""Answers to questions from a positional index: ranked pages, exact summaries, related terms, snippets, keywords."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import questions
from .postings import Index, page

#: Words and pairs that are no keywords.
COMMON = (
    "the and for with this that from are was were have has had not but you your its their they them our can will would should could into about "
    "these those been being does doing 这些 那些 我们 你们 他们 一个 这个 那个 以及 但是 然后 因此 所以 如果 虽然 可以 没有 就是 还有 进行 通过 对于 关于 出现 或者 并且"
).split()
MARK, UNMARK, CUT = "<mark>", "</mark>", "…"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_and_pairs(c: Column) -> Column:
    """Lower-cased words of two characters or more that start with a letter, and two ideographs in a row."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_-]+"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"[一-鿿]+"), F.lit(0)), lambda r: F.length(r) > 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.concat(F.transform(words, lambda w: F.lower(w)), F.flatten(F.transform(runs, pairs)))


def tallied(items: Column) -> Column:
    """array<struct<less, word>>: each distinct item with minus its count, the commonest first, ties by item."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(i == 0, True).otherwise(s[i] != s[i - 1]))
        ends = lambda at, r: F.coalesce(F.get(at, r + 1), F.size(s))
        return let(starts, lambda at: F.sort_array(F.transform(at, lambda a, r: F.struct((a - ends(at, r)).alias("less"), s[a].alias("word")))))

    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(F.array().cast("array<struct<less: int, word: string>>")))


def apart(ordered: Column, most: int, taken: Sequence[str] = ()) -> Column:
    """The first `most` words of an ordered list that neither hold nor lie in a word picked before, or one of `taken`."""
    near = lambda a, b: a.contains(b) | b.contains(a)
    free = F.filter(ordered, lambda w: ~reduce(Column.__or__, [near(w, F.lit(t.lower())) for t in taken], F.lit(False)))
    pick = lambda out, w: F.when((F.size(out) >= most) | F.exists(out, lambda p: near(p, w)), out).otherwise(F.array_append(out, w))
    return F.aggregate(free, F.array().cast("array<string>"), pick)


def keywords(c: Column, most: int = 5) -> Column:
    """array<string>: the commonest words and pairs of a text that don't overlap, ties by word, COMMON left out.

    Row by row, without a shuffle; null and empty texts have none.
    """
    known = F.filter(words_and_pairs(F.coalesce(c, F.lit(""))), lambda w: ~w.isin(*COMMON))
    return apart(F.transform(tallied(known), lambda x: x["word"]), most)


def clip(c: Column, most: int = 220) -> Column:
    """A marked text of at most `most` characters in all: cut with room for a closing mark and an ellipsis."""
    head = F.substring(c, 1, most - len(CUT) - len(UNMARK))
    closed = F.when(T.occurrences(head, MARK) > T.occurrences(head, UNMARK), F.concat(head, F.lit(UNMARK))).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(closed, F.lit(CUT)))


def snippet(c: Column, terms: Sequence[str], width: int = 80) -> Column:
    """The surroundings of the term that lets the snippet start first (ties: the earlier term), marked; a third of
    `width` before it, `width` after it. Without a match the first `width` characters; null is the empty text."""

    def around(flat: Column) -> Column:
        low, n = F.lower(flat), F.length(flat)
        places = [F.position(F.lit(t.lower()), low) for t in terms]  # from 1; 0: none
        at = [F.struct(F.greatest(F.lit(1), p - width // 3).alias("start"), F.lit(i).alias("nth"), p.alias("at"), F.lit(len(t)).alias("n")) for i, (t, p) in enumerate(zip(terms, places, strict=True))]
        best = F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))

        def cut(b: Column) -> Column:
            end = F.least(n, b["at"] + b["n"] + width - 1)
            own = F.coalesce(*[F.when(F.startswith(F.substring(low, b["at"], n), F.lit(t.lower())), len(t)) for t in terms])
            mid = F.concat(F.substring(flat, b["start"], b["at"] - b["start"]), F.lit(MARK), F.substring(flat, b["at"], own), F.lit(UNMARK), F.substring(flat, b["at"] + own, F.greatest(F.lit(0), end - b["at"] - own + 1)))
            return F.concat(F.when(b["start"] > 1, CUT).otherwise(""), mid, F.when(end < n, CUT).otherwise(""))

        plain = F.concat(F.substring(flat, 1, width), F.when(n > width, CUT).otherwise(""))
        return clip(F.coalesce(let(best, cut), plain))

    return let(T.collapsed(F.coalesce(c, F.lit(""))), around)


def source_of(terms: Sequence[str], window: Column, other: Column) -> Column:
    """Where a hit's snippet comes from: the window if it holds a term, else the other text if that does, else what there is."""
    holds = lambda c: reduce(Column.__or__, [T.contains(c, t) for t in terms])
    return F.when(holds(window), window).when(holds(other), other).otherwise(F.coalesce(F.when(window != "", window), other, F.lit("")))


def found(index: Index, df: DataFrame, terms: Sequence[str], weights: Sequence[float], quota: int | None = None) -> DataFrame:
    """key, hit_terms, field, best, score: rows of df (the scope) with any term.

    Terms that the index holds come from its lists, joined with the keys of df alone. Shorter ones are looked for in the
    texts of rows that have no hit yet: all of them, or with `quota` as many as fill it up, by key; these have no best.
    """
    key = index.key
    known, short = ([t for t in terms if bool(index.analyzer.cover(t)) is x] for x in (True, False))
    rows = index.scored(known, list(weights)).join(df.select(key), key, "left_semi") if known else None
    if not short or (rows is not None and quota is not None and (have := rows.limit(quota).count()) >= quota):
        return rows if rows is not None else df.select(key, F.lit(0).alias("hit_terms"), F.lit(0).alias("field"), F.lit(0.0).alias("best"), F.lit(0.0).alias("score")).limit(0)
    left = df if rows is None else df.join(rows.select(key), key, "left_anti")
    holds = [[T.contains(F.col(c), t) for c in index.columns] for t in short]
    hits = sum((reduce(Column.__or__, h).cast("int") for h in holds), F.lit(0))
    first = F.array_position(F.array(*[reduce(Column.__or__, f) for f in zip(*holds, strict=True)]), True) - 1
    none = F.lit(None).cast("double")
    fill = left.select(key, hits.alias("hit_terms"), first.cast("int").alias("field"), none.alias("best"), none.alias("score")).where("hit_terms > 0")
    if quota is not None:
        fill = fill.orderBy(key).limit(quota - (have if rows is not None else 0))
    return fill if rows is None else rows.select(fill.columns).unionByName(fill)


def refined(index: Index, df: DataFrame, long: Sequence[str], short: Sequence[str]) -> DataFrame:
    """Rows of df that hold all the long terms, by the index, and any of the short ones: only rows found are looked at."""
    every = [F.exists(F.col("tf")[i], lambda x: x > 0) for i in range(len(long))]
    ids = index.matches(list(long)).where(reduce(Column.__and__, every)).select(index.key)
    holds = reduce(Column.__or__, [T.contains(F.col(c), t) for t in short for c in index.columns])
    return df.join(ids, index.key, "left_semi").where(holds)


def every_match(index: Index, df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """key and columns of all rows of df that hold a term, without a limit: ids from the lists, columns by a semi join."""
    return df.select(index.key, *columns).join(index.matches([term]).select(index.key), index.key, "left_semi")


def answer(index: Index, df: DataFrame, question: str, weights: Sequence[float], limit: int = 20, text: str = "content", other: str = "title", newest: str = "updated_minute") -> DataFrame:
    """key, nth, title, snippet: the page that answers a question; windows of its terms where they find nothing.

    Texts are read for the page's rows alone: the window of the first term in them, then the snippet over all terms.
    """
    asked = questions.terms(question)
    rows = found(index, df, asked, weights, limit) if asked else None
    if rows is not None and rows.isEmpty() and (more := questions.windows(asked)):
        asked, rows = [*asked, *more], found(index, df, more, weights, limit)
    if rows is None:
        return df.select(index.key, F.lit(0).alias("nth"), "title", F.lit("").alias("snippet")).limit(0)
    shown = page(rows, df, limit, key=index.key, newest=newest, columns=tuple(dict.fromkeys(["title", text, other])))
    window = F.coalesce(*[T.window(F.col(text), t) for t in asked], F.substring(text, 1, 480), F.lit(""))
    return shown.select(index.key, "nth", "title", snippet(source_of(asked, window, F.col(other)), asked).alias("snippet"))


def summary(index: Index, df: DataFrame, terms: Sequence[str], group: str = "type", sample: int = 30, related: int = 5) -> DataFrame:
    """One row: total long, by_group map (group to rows), related array<string>.

    The total is exact over all rows that hold any term. Related terms are keywords of the titles of the first `sample`
    rows by key that overlap with no term.
    """
    rows = found(index, df, terms, [1.0] * len(index.columns)).select(index.key).join(df.select(index.key, group, "title"), index.key)
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(group, F.lit("")), "n")))).alias("by_group"))
    first = rows.orderBy(index.key).limit(sample).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.key, "title"))), lambda x: x["title"]), " ").alias("t"))  # at most `sample` rows
    likely = keywords(F.col("t"), 4 * related)
    taken = first.select(F.slice(F.filter(likely, lambda w: ~reduce(Column.__or__, [w.contains(t.lower()) | F.lit(t.lower()).contains(w) for t in terms])), 1, related).alias("related"))
    return counts.crossJoin(F.broadcast(taken)).select(F.coalesce("total", F.lit(0)).alias("total"), "by_group", "related")  # one row each
