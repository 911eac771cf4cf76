"""Quality audit, duplicates, normalisation plans, rule and score classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def audit(df: DataFrame, short_below: int = 500) -> DataFrame:
    """id, n_content, issues array<string>: empty, short, unclassified, language_variant, duplicate.

    Duplicates are equal contents of more than one row, by digest: one shuffle of (id, digest), not of bodies.
    """
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    flags = df.select(
        "id", n.alias("n_content"), F.col("collection").isNull().alias("_u"),
        F.coalesce(F.col("language") != T.language(F.col("language")), F.lit(True)).alias("_l"),
        F.sha2(F.coalesce("content", F.lit("")), 256).alias("_d"),
    )
    groups = flags.where("n_content > 0").groupBy("_d").agg(F.count("*").alias("_c")).where("_c > 1")
    joined = flags.join(groups, "_d", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("n_content") == 0, "empty"),
        F.when((F.col("n_content") > 0) & (F.col("n_content") < short_below), "short"),
        F.when(F.col("_u"), "unclassified"),
        F.when(F.col("_l"), "language_variant"),
        F.when(F.col("_c").isNotNull() & (F.col("n_content") > 0), "duplicate"),
    ))
    return joined.select("id", F.col("n_content").cast("long").alias("n_content"), issues.alias("issues"))


def issue_counts(audited: DataFrame) -> DataFrame:
    """issue, n with the rows without issues as `clean`."""
    each = F.explode(F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(F.lit("clean"))))
    return audited.select(each.alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def dedup_plan(df: DataFrame, keep: list[Column], content: str = "content", least_size: int = 1024) -> DataFrame:
    """id, sha256, action keep, delete or suspicious, keeper: for groups of equal content of two rows or more.

    keep orders a group, best first. Groups of tiny contents are suspicious and none of their rows goes.
    """
    hashed = df.withColumns({"sha256": F.sha2(F.coalesce(content, F.lit("")), 256), "_size": F.octet_length(F.coalesce(content, F.lit("")))}).drop(content)
    # the hash of a size is known before the group is: only rows of groups go through the ordered window
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("_c")).where("_c > 1")
    by = Window.partitionBy("sha256").orderBy(*keep)
    ranked = hashed.join(groups, "sha256").withColumns({"_n": F.row_number().over(by), "keeper": F.first("id").over(by)})
    action = F.when(F.col("_size") <= least_size, "suspicious").when(F.col("_n") == 1, "keep").otherwise("delete")
    return ranked.select("id", "sha256", action.alias("action"), "keeper")


def language_plan(df: DataFrame) -> DataFrame:
    """from_code, to_code, n for all codes, changed or not."""
    return df.groupBy(F.col("language").alias("from_code")).agg(F.count("*").alias("n")).select("from_code", T.language(F.col("from_code")).alias("to_code"), "n")


def classify_by_rules(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Name of the first rule with a keyword in the lower-cased text; null if none has."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def classify_by_score(c: Column, rules: list[tuple[str, list[str]]], least: int = 4, margin: float = 1.5) -> Column:
    """Rule of the largest sum of occurrences, a keyword of three or more characters counting twice its length.

    Keywords of one character don't count. Accepted from `least` on and `margin` times the second; ties keep rule order.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    scores = []
    for i, (name, words) in enumerate(rules):
        total = sum((T.occurrences(low, w.lower()) * (2 * len(w) if len(w) >= 3 else 1) for w in words if len(w) > 1), F.lit(0).cast("long"))
        scores.append(F.struct((-total).alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    ranked = F.sort_array(F.array(*scores))
    best = -ranked[0]["minus"]
    second = -ranked[1]["minus"] if len(rules) > 1 else F.lit(0)
    return F.when((best >= least) & (best >= margin * second), ranked[0]["name"])


def staleness(df: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """key, stale: no snapshot, or the row changed after it was checked."""
    joined = df.select(key, "updated_at").join(snapshot.select(key, "checked_at"), key, "left")
    return joined.select(key, (F.col("checked_at").isNull() | (F.col("updated_at") > F.col("checked_at"))).alias("stale"))
