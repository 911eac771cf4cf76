"""Maintenance of a shelf: language changes, texts to extract again and their log, restores of several tables, TSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval
from .changes import restore
from .intake import inside

#: The largest batch of one logged operation; the byte order mark and header of annotation files.
BATCH, BOM, HEADER = 500, "\ufeff", ("front", "back", "type", "book")
#: A book without a title, and what stands before a book's name.
NO_TITLE, FROM = "无标题", "— 《"


def normalised(code: Column) -> Column:
    """en, zh or ja for codes that begin so, und for blanks and nulls, other codes trimmed but as they stand."""
    c = F.trim(F.coalesce(code, F.lit("")))
    out = F.when(c == "", "und")
    for k in ("en", "zh", "ja"):
        out = out.when(F.lower(c).startswith(k), k)
    return out.otherwise(c)


def language_changes(df: DataFrame) -> DataFrame:
    """id, from_code, to_code of the rows whose language would change."""
    rows = df.select("id", F.col("language").alias("from_code"), normalised(F.col("language")).alias("to_code"))
    return rows.where(~F.col("from_code").eqNullSafe(F.col("to_code")))


def transitions(changes: DataFrame) -> DataFrame:
    """from_code (empty for none), to_code, n: how many rows go which way."""
    return changes.groupBy(F.coalesce("from_code", F.lit("")).alias("from_code"), "to_code").agg(F.count("*").alias("n"))


def language_report(df: DataFrame, known: tuple[str, ...] = ("en", "zh", "ja", "und")) -> DataFrame:
    """One row: total, changed, unchanged, batches of BATCH rows, and unmapped rows: those that end up in no known code."""
    to = normalised(F.col("language"))
    changed = F.count_if(~F.col("language").eqNullSafe(to))
    counted = df.agg(F.count("*").alias("total"), changed.alias("changed"), F.count_if(~to.isin(*known)).alias("unmapped"))
    return counted.select("total", "changed", (F.col("total") - F.col("changed")).alias("unchanged"), F.ceil(F.col("changed") / BATCH).alias("batches"), "unmapped")


def extract_reasons(df: DataFrame, formats: tuple[str, ...], root: str = "files") -> DataFrame:
    """id, reason: candidate for another extraction, or why not: no_file, format:<name>, illegal_path, file_missing."""
    path, kind = F.coalesce("file_path", F.lit("")), F.lower(F.coalesce("format", F.lit("")))
    named = F.concat(F.lit("format:"), F.when(kind == "", "<none>").otherwise(kind))
    reason = (
        F.when(path == "", "no_file").when(~kind.isin(*formats), named).when(~inside(path, root), "illegal_path")
        .when(~F.coalesce("file_exists", F.lit(False)), "file_missing").otherwise("candidate")
    )
    return df.select("id", reason.alias("reason"))


def job_log(outcomes: DataFrame, kind: str = "reextract") -> DataFrame:
    """At most one row: kind, updated, skipped, empty, failed, undoable (never) of a job's outcomes (id, outcome); no row
    if nothing was updated."""
    names = ("updated", "skipped", "empty", "failed")
    row = outcomes.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    return row.where("updated > 0").select(F.lit(kind).alias("kind"), *names, F.lit(False).alias("undoable"))


def insight(df: DataFrame, most: int = 5) -> DataFrame:
    """id, summary, tags: the first sentence, and keywords of title and content that don't overlap."""
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return df.select("id", T.summary(T.collapsed("content")).alias("summary"), retrieval.keywords(both, most).alias("tags"))


def escaped(c: Column) -> Column:
    """A TSV cell with backslashes, tabs and line ends written as two characters."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def annotation_lines(annotations: DataFrame, df: DataFrame) -> DataFrame:
    """book, created_minute, id, line: a TSV line for each annotation (quote, content, type) of a live document.

    The front is the quote or, without one, the content; the back has the content, if both are there, and the book.
    """
    live = df.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("book"))
    quote, content = (T.stripped(F.col(c)) for c in ("quote", "content"))
    source = F.concat(F.lit(FROM), F.when(F.col("book") == "", NO_TITLE).otherwise(F.col("book")), F.lit("》"))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    back = F.when(given("quote") & given("content"), F.concat(content, F.lit("\n"), source)).otherwise(source)
    cells = [escaped(F.when(quote != "", quote).otherwise(content)), escaped(back), F.col("type"), escaped(F.col("book"))]
    return annotations.join(live, "document_id").select("book", "created_minute", "id", F.concat_ws("\t", *cells).alias("line"))


def annotation_file(annotations: DataFrame, df: DataFrame) -> DataFrame:
    """line: mark and header, then the lines by book and time. Write with write.text: rows are ordered by ranges, so
    files in the order of their names make one TSV file."""
    rows = annotation_lines(annotations, df).select(F.lit(1).alias("_p"), F.col("book").alias("_b"), F.col("created_minute").cast("long").alias("_c"), F.col("id").cast("long").alias("_i"), "line")
    head = df.sparkSession.range(1).select(F.lit(0).alias("_p"), F.lit("").alias("_b"), F.lit(0).cast("long").alias("_c"), F.lit(0).cast("long").alias("_i"), F.lit(BOM + "\t".join(HEADER)).alias("line"))
    return head.unionByName(rows).orderBy("_p", "_b", "_c", "_i").select("line")


def coerced(df: DataFrame, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df with the types of the columns that `like` has too, rows whose values don't fit): other columns go."""
    types = dict(like.dtypes)
    names = [c for c in df.columns if c in types]
    cast = [F.col(c).try_cast(types[c]).alias(c) for c in names]
    bad = F.lit(False)
    for c in names:
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull())
    return df.where(~bad).select(*cast), df.where(bad)


def restored_tables(current: dict[str, DataFrame], backup: dict[str, DataFrame], keys: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after an upsert of the backup's rows by key, name and counts: rows, refused).

    Tables that the backup lacks stay; names that no table has are refused as a whole. Values come as text and take the
    types of the table; a row with a value that doesn't fit is refused, the others go in.
    """
    unknown = sorted(set(backup) - set(current))
    if unknown:
        raise ValueError(f"unknown tables: {unknown}")
    out, counts = dict(current), None
    for name, rows in backup.items():
        good, bad = coerced(rows, current[name])
        out[name] = restore(current[name], good, keys[name])
        one = good.agg(F.count("*").alias("rows")).crossJoin(bad.agg(F.count("*").alias("refused"))).select(F.lit(name).alias("name"), "rows", "refused")  # one row each
        counts = one if counts is None else counts.unionByName(one)
    return out, counts
