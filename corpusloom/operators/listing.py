"""Filters, facets, sorts and pages over documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class FilterSpec:
    """One specification for lists, counts, ids and facets; None leaves a filter out."""

    collections: tuple[str, ...] = ()
    language: str | None = None
    text: str | None = None
    text_columns: tuple[str, ...] = ("title", "content")
    quality: str | None = None
    short_below: int = 500
    include_deleted: bool = False
    extra: Column | None = field(default=None, compare=False)

    def predicates(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if not self.include_deleted and "deleted_at" in df.columns:
            out["alive"] = F.col("deleted_at").isNull()
        if self.collections:
            out["collection"] = F.col("collection").isin(*self.collections)
        if self.language:
            out["language"] = T.language(F.col("language")) == T.language(F.lit(self.language))
        if self.text:
            out["text"] = reduce(Column.__or__, [T.contains(F.col(c), self.text) for c in self.text_columns])
        if self.quality:
            out["quality"] = quality_predicate(self.quality, self.short_below)
        if self.extra is not None:
            out["extra"] = self.extra
        return out


def quality_predicate(kind: str, short_below: int = 500) -> Column:
    """empty, short, language_variant or issues (any of them); other names are refused."""
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    arms = {
        "empty": n == 0,
        "short": (n > 0) & (n < short_below),
        "language_variant": F.coalesce(F.col("language") != T.language(F.col("language")), F.lit(True)),
    }
    if kind == "issues":
        return reduce(Column.__or__, [F.coalesce(a, F.lit(False)) for a in arms.values()])
    if kind not in arms:
        raise ValueError(f"unknown quality filter: {kind}")
    return arms[kind]


def apply_filters(df: DataFrame, spec: FilterSpec, without: str | None = None) -> DataFrame:
    """Rows that meet the specification; `without` leaves one filter out (facets of its own dimension)."""
    return reduce(DataFrame.where, [p for k, p in spec.predicates(df).items() if k != without], df)


def facets(df: DataFrame, spec: FilterSpec, dimensions: tuple[str, ...], most: int = 100) -> DataFrame:
    """dimension, value, n: each dimension counted without its own filter, in one scan of df.

    Every row is exploded to one struct a dimension whose filters it passes, so a dimension costs no scan of its own.
    The `most` largest values of a dimension, ties by value; null values count as ''.
    """
    preds = spec.predicates(df)
    passes = lambda d: reduce(Column.__and__, [p for k, p in preds.items() if k != d], F.lit(True))
    structs = [F.when(passes(d), F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value"))) for d in dimensions]
    counted = df.select(F.explode(F.array_compact(F.array(*structs))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0, cap: int = 1000) -> DataFrame:
    """One page of a total order; give a unique last key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(limit, cap))


def ids_with_total(df: DataFrame, key: str = "id", cap: int = 5000) -> DataFrame:
    """key, total, truncated: the first `cap` ids with the whole count, in one pass over the narrow column."""
    total = df.agg(F.count("*").alias("total"))
    return df.select(key).orderBy(key).limit(cap).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > cap)


def status_bucket(progress: Column) -> Column:
    return F.when(F.coalesce(progress, F.lit(0.0)) <= 0, "unread").when(progress >= 1, "done").otherwise("reading")
