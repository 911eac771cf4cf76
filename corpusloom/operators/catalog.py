"""Shelves: scope, tags, facets with truncation flags, named sorts, quality arms and summaries over snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCOPE = ("book", "pdf")
#: Languages that are no variant of another one.
STANDARD = ("zh", "en", "ja", "und")
#: Named orders, each ending in the id.
SORTS = {
    "created_desc": lambda: [F.desc("created_minute"), F.desc("id")],
    "created_asc": lambda: [F.asc("created_minute"), F.asc("id")],
    "title_asc": lambda: [F.asc("title"), F.asc("id")],
    "author_asc": lambda: [F.coalesce("author", F.lit("")).asc(), F.asc("title"), F.asc("id")],
    "last_read_desc": lambda: [F.desc_nulls_last("read_minute"), F.desc("id")],
    "progress_desc": lambda: [F.coalesce("progress", F.lit(0.0)).desc(), F.desc("id")],
    "file_size_desc": lambda: [F.coalesce("file_size", F.lit(0)).desc(), F.desc("id")],
}


def alive(df: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are not deleted, of the given types (any if none is given)."""
    return df.where(~F.col("deleted") & (F.col("type").isin(*types) if types else F.lit(True)))


def lookup(df: DataFrame, key, include_deleted: bool = False) -> DataFrame:
    """The row of a key, or none; deleted rows only if asked for."""
    return df.where((F.col("id") == key) & (F.lit(include_deleted) | ~F.col("deleted")))


def with_tags(df: DataFrame, bridge: DataFrame, *names: str) -> DataFrame:
    """Rows that carry every one of the tags; each is a semi join, so rows never multiply."""
    for name in names:
        df = df.join(bridge.where(F.col("tag") == name).select("id"), "id", "left_semi")
    return df


def sort(df: DataFrame, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in one of the named orders; unknown names are refused."""
    if name not in SORTS:
        raise ValueError(f"unknown order: {name}")
    return df.orderBy(*SORTS[name]()).offset(offset).limit(limit)


def top_values(counted: DataFrame, most: int) -> DataFrame:
    """value, n, truncated: the `most` largest values, ties by value; one more is fetched to see whether there are more."""
    first = counted.orderBy(F.desc("n"), "value").limit(most + 1)
    place = Window.orderBy(F.desc("n"), "value")  # over at most most + 1 rows
    every = Window.partitionBy(F.lit(1))
    return first.select("value", "n", F.row_number().over(place).alias("_i"), (F.count("*").over(every) > most).alias("truncated")).where(F.col("_i") <= most).drop("_i")


def tag_facet(df: DataFrame, bridge: DataFrame, most: int = 50) -> DataFrame:
    """Documents by tag, each once however often the bridge holds it."""
    pairs = bridge.select("id", "tag").distinct().join(df.select("id"), "id")
    return top_values(pairs.groupBy(F.col("tag").alias("value")).agg(F.count("*").alias("n")), most)


def author_facet(df: DataFrame, most: int = 50) -> DataFrame:
    """Documents by author; blank and missing authors don't count."""
    return top_values(df.where("trim(author) <> ''").groupBy(F.col("author").alias("value")).agg(F.count("*").alias("n")), most)


def category_facet(df: DataFrame, names: DataFrame) -> DataFrame:
    """collection, name, n: documents by category with its name where known; null collection: those without one."""
    counted = df.groupBy("collection").agg(F.count("*").alias("n"))
    return counted.join(names.select("collection", "name"), "collection", "left").select("collection", "name", "n")


def by_type(df: DataFrame) -> DataFrame:
    """type, n, started, completed."""
    p = F.coalesce("progress", F.lit(0.0))
    return df.groupBy("type").agg(F.count("*").alias("n"), F.count_if(p > 0).alias("started"), F.count_if(p >= 1).alias("completed"))


def variant(code: Column) -> Column:
    """Whether a language code is not one of the standard ones as it stands; null and empty are none."""
    return F.coalesce((code != "") & ~F.lower(F.trim(code)).isin(*STANDARD), F.lit(False))


def audit(df: DataFrame, threshold: int = 500) -> DataFrame:
    """id, content_chars, group_size, issues array<string> of nine codes, in their order.

    Duplicates are equal contents, by digest: (id, digest) is shuffled, not the bodies.
    """
    n = F.length(F.trim(F.coalesce("content", F.lit("")))).cast("long")
    flags = df.select(
        "id", n.alias("content_chars"), F.sha2("content", 256).alias("_d"), variant(F.col("language")).alias("_v"), F.col("collection").isNull().alias("_u"),
        (F.coalesce("file_path", F.lit("")) != "").alias("_f"), (F.coalesce("cover_path", F.lit("")) != "").alias("_c"), "file_exists", "cover_exists", "format",
    )
    sizes = flags.where("content_chars > 0").groupBy("_d").agg(F.count("*").alias("group_size"))
    rows = flags.join(sizes, "_d", "left")
    short, size = F.col("content_chars") < threshold, F.coalesce("group_size", F.lit(1)).cast("long")
    issues = F.array_compact(F.array(
        F.when(F.col("_f") & ~F.col("file_exists"), "missing_file"), F.when(F.col("_c") & ~F.col("cover_exists"), "orphan_cover"),
        F.when(F.col("content_chars") == 0, "empty_content"), F.when((F.col("content_chars") > 0) & short, "short_content"),
        F.when(~F.col("_c"), "no_cover"), F.when(F.col("_u"), "unclassified"), F.when((F.lower("format") == "pdf") & short & F.col("file_exists"), "needs_ocr"),
        F.when(F.col("_v"), "language_variant"), F.when(size > 1, "duplicate_sha"),
    ))
    return rows.select("id", "content_chars", size.alias("group_size"), issues.alias("issues"))


def with_issue(audited: DataFrame, df: DataFrame, issue: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """id, title, issues, total: a page of the rows with an issue, or with any (`all`), by title."""
    hit = audited.where(F.size("issues") > 0 if issue == "all" else F.array_contains("issues", issue))
    rows = df.select("id", "title").join(hit.select("id", "issues"), "id")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("title", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def snapshot_arm(df: DataFrame, snapshot: DataFrame, arm: str) -> DataFrame:
    """Rows by what the last audit (id, checked_minute, issues) says: needs_ocr, missing_file, duplicate or not_audited."""
    if arm == "not_audited":
        return df.join(snapshot.select("id"), "id", "left_anti")
    code = {"needs_ocr": "needs_ocr", "missing_file": "missing_file", "duplicate": "duplicate_sha"}.get(arm)
    if code is None:
        raise ValueError(f"unknown arm: {arm}")
    return df.join(snapshot.where(F.array_contains("issues", code)).select("id"), "id", "left_semi")


#: Names of the quality filter; the last two need the last audit, `issues` is any but not_audited.
QUALITY_KINDS = ("empty_content", "short_content", "no_cover", "unclassified", "language_variant", "needs_ocr", "missing_file", "duplicate", "not_audited", "issues")


def quality_kinds(df: DataFrame, snapshot: DataFrame, threshold: int = 500) -> DataFrame:
    """df plus quality array<string>: all names of QUALITY_KINDS that hold of a row, in their order.

    What is cheap is judged as the row is now, the rest as the last audit (id, issues) found it: one join for all names.
    """
    n, cover = F.length(F.trim(F.coalesce("content", F.lit("")))), F.coalesce("cover_path", F.lit(""))
    code = F.coalesce("language", F.lit(""))
    now = [n == 0, (n > 0) & (n < threshold), cover == "", F.col("collection").isNull(), (code != "") & ~code.isin(*STANDARD)]
    then = [F.coalesce(F.array_contains("_i", c), F.lit(False)) for c in ("needs_ocr", "missing_file", "duplicate_sha")]
    tests = [*now, *then, F.col("_i").isNull()]
    tests.append(reduce(Column.__or__, [*now, *then]))
    rows = df.join(snapshot.select("id", F.coalesce("issues", F.array().cast("array<string>")).alias("_i")), "id", "left")
    return rows.withColumn("quality", F.array_compact(F.array(*[F.when(t, k) for t, k in zip(tests, QUALITY_KINDS, strict=True)]))).drop("_i")


def of_quality(df: DataFrame, snapshot: DataFrame, kind: str, threshold: int = 500) -> DataFrame:
    """Rows of df of a quality; unknown names are refused."""
    if kind not in QUALITY_KINDS:
        raise ValueError(f"unknown quality: {kind}")
    return quality_kinds(df, snapshot, threshold).where(F.array_contains("quality", kind)).drop("quality")


def quality_summary(df: DataFrame, snapshot: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """One row: total, audited, stale (changed after the audit, or never audited), last audit, and a count for each code."""
    joined = df.select("id", "updated_minute").join(snapshot.select("id", F.col("checked_minute").alias("at"), "issues"), "id", "left")
    counts = [F.count_if(F.array_contains("issues", c)).alias(c) for c in codes]
    stale = F.col("at").isNull() | (F.col("updated_minute") > F.col("at"))
    return joined.agg(F.count("*").alias("total"), F.count("at").alias("audited"), F.count_if(stale).alias("stale"), F.max("at").alias("last_audit"), *counts)


def by_reason(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n: counts by one or more columns."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def tiered(title: Column, content: Column, rules: list, by_rule, by_score) -> Column:
    """A category by the title's rules, else by the content's scores."""
    return F.coalesce(by_rule(title, rules), by_score(content, rules))


def classify_plan(df: DataFrame, category: Column, known: DataFrame, catch_all: tuple[str, ...] = ()) -> DataFrame:
    """id, category, outcome: move, or why not: no match, unknown category, already there, not in a catch-all.

    known has the names of collections. With catch_all only documents without a collection or in one of those move.
    """
    rows = df.select("id", "collection", category.alias("category")).join(known.select(F.col("name").alias("category"), F.lit(True).alias("_k")).distinct(), "category", "left")
    free = F.col("collection").isNull() | F.col("collection").isin(*catch_all) if catch_all else F.lit(True)
    outcome = (
        F.when(F.col("category").isNull(), "no match").when(F.col("_k").isNull(), "unknown category")
        .when(F.col("collection").eqNullSafe(F.col("category")), "already there").when(~free, "not in a catch-all").otherwise("move")
    )
    return rows.select("id", "category", outcome.alias("outcome"))


def extract_plan(df: DataFrame, new: Column, formats: tuple[str, ...], only_if_longer: bool = True) -> DataFrame:
    """id, outcome of extracting a text again: updated, skipped, empty or failed (no file, or null text)."""
    n, old = F.length(new), F.length(F.coalesce("content", F.lit("")))
    same = n <= old if only_if_longer else new == F.coalesce("content", F.lit(""))
    outcome = (
        F.when((F.coalesce("file_path", F.lit("")) == "") | ~F.lower("format").isin(*formats), "skipped").when(~F.col("file_exists") | new.isNull(), "failed")
        .when(n == 0, "empty").when(same, "skipped").otherwise("updated")
    )
    return df.select("id", outcome.alias("outcome"))


def near_exact(df: DataFrame) -> DataFrame:
    """id, keeper: rows of one title and size; the earliest created one stays."""
    by = Window.partitionBy("title", "file_size").orderBy("created_minute", "id")
    return df.select("id", F.first("id").over(by).alias("keeper"), F.row_number().over(by).alias("_n")).where("_n > 1").drop("_n")


def language_by_prefix(code: Column) -> Column:
    """Codes that begin with en, zh or ja as those, others as they stand."""
    low = F.lower(F.trim(code))
    out = F.when(low.startswith("en"), "en")
    for k in ("zh", "ja"):
        out = out.when(low.startswith(k), k)
    return out.otherwise(code)


def standard_language(code: Column) -> Column:
    """The audit's reading of a code: one of the standard ones, everything else as und."""
    known = T.language(code)
    return F.when(known.isin(*STANDARD), known).otherwise("und")


def reindex_counts(df: DataFrame, new: Column, formats: tuple[str, ...], digest: Column) -> DataFrame:
    """One row: total, updated, skipped, empty, sha_backfilled over documents that are not deleted and have a file.

    Documents of the formats without content take the text `new`: updated where it has one, else empty. The others are
    skipped. `digest` is the stored hash: one is filled in where it is null or empty and the file exists.
    """
    asks = F.coalesce(F.col("format").isin(*formats), F.lit(False)) & (F.coalesce(F.length("content"), F.lit(0)) == 0)
    got = F.coalesce(F.length(new), F.lit(0)) > 0
    no_hash = (F.coalesce(digest, F.lit("")) == "") & F.coalesce("file_exists", F.lit(False))
    return df.where(~F.coalesce("deleted", F.lit(False)) & F.col("file_path").isNotNull()).agg(
        F.count("*").alias("total"), F.count_if(asks & got).alias("updated"), F.count_if(~asks).alias("skipped"),
        F.count_if(asks & ~got).alias("empty"), F.count_if(no_hash).alias("sha_backfilled"),
    )
