"""A listing source: directory trees as rows, with what file readers leave out (files of 0 bytes) and without links."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

#: Sizes of files that are empty or an error page, and formats that can be imported.
BAD_SIZES = (0, 143)
FORMATS = ("pdf", "epub", "txt", "md", "html", "mobi", "azw3")


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    """One partition for the root's own files, one for each folder right below it."""

    def __init__(self, root: str, most: int):
        self.root, self.most = root, most

    def partitions(self) -> list[Subtree]:
        if not os.path.isdir(self.root):
            return [Subtree(self.root, False)]
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [Subtree(self.root, False), *(Subtree(p, True) for p in below)]

    def read(self, part: Subtree) -> Iterator[tuple]:
        """At most `most` + 1 files of the subtree, in the order of a sorted walk: a folder's files before its folders."""
        left = self.most + 1
        for folder, below, names in os.walk(part.folder):
            below[:] = sorted(d for d in below if not os.path.islink(os.path.join(folder, d))) if part.deep else []
            inner = [] if folder == self.root else os.path.relpath(folder, self.root).split(os.sep)
            for name in sorted(names):
                path = os.path.join(folder, name)
                if os.path.islink(path):
                    continue
                try:
                    facts = os.stat(path)
                except FileNotFoundError:  # went meanwhile
                    continue
                yield "/".join([*inner, name]), name, facts.st_size, int(facts.st_mtime), [*(f"1{d}" for d in inner), f"0{name}"]
                left -= 1
                if not left:
                    return


class Listing(DataSource):
    """spark.read.format("folder_listing").option("most", n).load(path): path (relative), name, size, mtime, place.

    `place` sorts as a sorted walk goes. The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, name string, size long, mtime long, place array<string>"

    def reader(self, schema) -> ListingReader:
        return ListingReader(os.path.abspath(self.options["path"]), int(self.options.get("most", 5000)))


def scan(spark: SparkSession, path: str, most: int = 5000, bad_sizes: tuple[int, ...] = BAD_SIZES, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """path, name, size, mtime, kind, duplicate_of, truncated: the first `most` files of a sorted walk.

    kind: bad (by size), else unsupported (by ending), else duplicate (name and size of an earlier importable file),
    else importable. truncated: whether there are more. A missing folder gives no rows; links are neither followed nor
    listed.
    """
    spark.dataSource.register(Listing)
    rows = spark.read.format("folder_listing").option("most", most).load(path)
    first = rows.orderBy("place").limit(most + 1)
    nth = F.row_number().over(Window.orderBy("place"))  # over at most `most` + 1 rows
    first = first.withColumn("_n", nth).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most).where(F.col("_n") <= most)
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    plain = F.when(F.col("size").isin(*bad_sizes), "bad").when(~suffix.isin(*formats), "unsupported").otherwise("importable")
    kept = first.withColumn("_k", plain)
    earlier = F.first("path").over(Window.partitionBy("_k", "name", "size").orderBy("place"))
    twin = (F.col("_k") == "importable") & (earlier != F.col("path"))
    out = kept.select("path", "name", "size", "mtime", F.when(twin, "duplicate").otherwise(F.col("_k")).alias("kind"), F.when(twin, earlier).alias("duplicate_of"), "truncated")
    return out


@F.pandas_udf(StringType())
def laddered(content: pd.Series) -> pd.Series:
    """The text of bytes in the first of UTF-8, GB18030 and Latin-1 that takes them all; null stays null."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("latin-1")

    return content.map(one)


def decoded(content, most: int = 200_000):
    """A binary column as text by the ladder, at most `most` characters."""
    return F.substring(laddered(content), 1, most)
