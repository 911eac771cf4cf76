"""One specification of a shelf's list: parsed from what a user typed, written back, applied to lists and counts alike."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalog

#: Reading states of a shelf, the states that the list alone knows, views.
STATUSES, SHELVES, VIEWS = ("reading", "unread", "done"), ("all", "reading", "unread", "done", "recent"), ("grid", "list")


def status_predicate(status: str | None) -> Column | None:
    """None for all; unknown states are refused."""
    p = F.col("progress")
    known = {"reading": (p > 0) & (p < 1), "unread": p.isNull() | (p <= 0), "done": p >= 1}
    if not status or status == "all":
        return None
    if status not in known:
        raise ValueError(f"unknown status: {status}")
    return F.coalesce(known[status], F.lit(False))


@dataclass(frozen=True)
class ShelfFilter:
    """Filters of a shelf; None and empty texts leave one out. `types` holds of every shelf."""

    q: str = ""
    shelf: str = "all"
    category: str | None = None
    author: str | None = None
    quality: str | None = None
    format: str | None = None
    language: str | None = None
    tag: str | None = None
    sort: str = "created_desc"
    view: str = "grid"
    types: tuple[str, ...] = ("book", "pdf")

    @classmethod
    def parse(cls, given: Mapping[str, str | None]) -> ShelfFilter:
        """From a user's input, which never fails: blanks are trimmed, unknown names fall back to the default.

        The shelf of what came last has its own order.
        """
        text = lambda k: (given.get(k) or "").strip() or None
        one = lambda k, names, default: given.get(k) if given.get(k) in names else default
        shelf, code = one("shelf", SHELVES, "all"), text("language")
        return cls(
            q=text("q") or "", shelf=shelf, category=text("category"), author=text("author"), quality=one("quality", catalog.QUALITY_KINDS, None),
            format=text("format") and text("format").lower(), language=code and T.language_of(code), tag=text("tag"),
            sort="created_desc" if shelf == "recent" else one("sort", catalog.SORTS, "created_desc"), view=one("view", VIEWS, "grid"),
        )

    def written(self) -> dict[str, str]:
        """What parse() reads, in the order of the fields, without defaults."""
        blank = ShelfFilter()
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "types"}
        own["q"] = own["q"].strip()
        return {k: v for k, v in own.items() if v and v != getattr(blank, k) and not (k == "sort" and self.shelf == "recent")}

    def predicates(self) -> dict[str, Column]:
        """What single rows of logical documents tell, by filter; tags and quality need other tables."""
        out = {"alive": ~F.col("deleted"), "types": F.col("type").isin(*self.types) if self.types else None, "shelf": status_predicate(None if self.shelf == "recent" else self.shelf)}
        if self.category:
            out["category"] = F.col("collection") == self.category
        if self.author:
            out["author"] = T.contains(F.col("author"), self.author)
        if self.format:
            out["format"] = F.lower("format") == self.format.lower()
        if self.language:
            out["language"] = T.language(F.col("language")) == T.language(F.lit(self.language))
        if self.q.strip():
            out["q"] = reduce(Column.__or__, [T.contains(F.col(c), self.q.strip()) for c in ("title", "author", "content")])
        return {k: v for k, v in out.items() if v is not None}

    def rows(self, df: DataFrame, tags: DataFrame | None = None, snapshot: DataFrame | None = None, without: str | None = None) -> DataFrame:
        """Rows of df that pass; `without` leaves one filter out, for facets of its own dimension.

        Filters of single rows come first, so that they reach the scan; then the tag's semi join and the audit's join.
        """
        out = reduce(DataFrame.where, [p for k, p in self.predicates().items() if k != without], df)
        if self.tag and without != "tag":
            out = catalog.with_tags(out, tags, self.tag)
        if self.quality and without != "quality":
            out = catalog.of_quality(out, snapshot, self.quality)
        return out

    def page(self, df: DataFrame, tags: DataFrame | None = None, snapshot: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of the rows in the order of `sort`."""
        return catalog.sort(self.rows(df, tags, snapshot), self.sort, limit, offset)
