"""Imports: sniffing, safe paths, outcomes of batches, folders, clients' JSON, web clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.listing import decoded

#: First bytes of image files, in hex.
IMAGES = {"jpg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638"}
PAYLOAD = "struct<books:array<struct<id:string,title:string,progress:double,addedAt:bigint>>,notes:array<struct<id:string,bookId:string,text:string,createdAt:bigint>>,bookmarks:array<struct<id:string,bookId:string,page:int>>,records:array<struct<bookId:string,start:bigint,end:bigint>>>"


def image_kind(content: Column) -> Column:
    """jpg, png, gif or webp by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for kind, magic in IMAGES.items():
        out = out.when(head.startswith(magic), kind)
    return out


def text_kind(content: Column) -> Column:
    """pdf, html or text by the first 2,048 bytes: what a file is, whatever its name says."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return F.when(head.startswith("%pdf"), "pdf").when(head.contains("<html") | head.contains("<!doctype html"), "html").otherwise("text")


def directory_id(path: Column) -> Column:
    """A stable id of 12 hex digits."""
    return F.substring(F.sha2(path, 256), 1, 12)


def inside(path: Column, root: str) -> Column:
    """Whether a path is safe and below a root: no absolute path elsewhere, no parent steps, no back slashes or NULs."""
    root = root.rstrip("/")
    bad = path.contains("\\") | path.contains(chr(0)) | F.exists(F.split(path, "/"), lambda x: x == "..")
    return ~bad & path.startswith(f"{root}/")


def outcomes(asked: DataFrame, listing: DataFrame, known: DataFrame) -> DataFrame:
    """path, outcome of importing each asked path: imported, duplicate (name and size known, or asked before), failed."""
    rows = asked.select("path", "nth").join(listing.select("path", "name", "size"), "path", "left")
    there = known.select("name", "size", F.lit(True).alias("_k")).distinct()
    first = F.row_number().over(Window.partitionBy("name", "size").orderBy("nth"))
    rows = rows.withColumn("_n", first).join(there, ["name", "size"], "left")
    outcome = F.when(F.col("size").isNull(), "failed").when(F.col("_k").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("imported")
    return rows.select("path", outcome.alias("outcome"))


def folder_load(listing: DataFrame, known: DataFrame) -> DataFrame:
    """title, size, category of files to load: stem and parent folder of the path; those known by title and size are left out."""
    stem, folder = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return listing.select(stem.alias("title"), "size", folder.alias("category")).join(known.select("title", "size"), ["title", "size"], "left_anti")


def scans(listings: dict[str, DataFrame], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(directory, path, kind: a preview of `most` rows, shared out evenly; directory, kind, n) over several listings."""
    both = None
    for name, df in listings.items():
        rows = df.select(F.lit(name).alias("directory"), "path", "kind")
        both = rows if both is None else both.unionByName(rows)
    nth = F.row_number().over(Window.partitionBy("directory").orderBy("path"))
    preview = both.withColumn("_n", nth).where(F.col("_n") <= most // max(1, len(listings))).drop("_n")
    return preview, both.groupBy("directory", "kind").agg(F.count("*").alias("n"))


def time_of(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def share_of(percent: Column) -> Column:
    """0 to 100 as 0 to 1, cut at both ends; null as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(percent, F.lit(0.0)) / 100))


def client_tables(payload: DataFrame, column: str = "payload") -> dict[str, DataFrame]:
    """books, notes, bookmarks and records of a client's JSON; what belongs to no book of the payload is left out."""
    p = payload.select(F.from_json(column, PAYLOAD).alias("p"))
    each = {k: p.select(F.explode(f"p.{k}").alias("x")).select("x.*") for k in ("books", "notes", "bookmarks", "records")}
    books = each["books"].select("id", "title", share_of(F.col("progress")).alias("progress"), time_of(F.col("addedAt")).alias("added_at"))
    own = books.select(F.col("id").alias("bookId")).distinct()
    rows = {k: each[k].join(own, "bookId", "left_semi") for k in ("notes", "bookmarks", "records")}
    return {
        "books": books, "notes": rows["notes"].select("id", "bookId", "text", time_of(F.col("createdAt")).alias("created_at")),
        "bookmarks": rows["bookmarks"], "records": rows["records"].select("bookId", time_of(F.col("start")).alias("start"), time_of(F.col("end")).alias("end")),
    }


def page_text(html: Column, most: int = 200_000) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the commonest references decoded, white space as one space."""
    t = html
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.substring(F.trim(F.regexp_replace(t, "[ \\t\\r\\n\\f\\v]+", " ")), 1, most)


#: Formats of books, and what a page's first bytes hold.
BOOKS, PAGE_SIGNS = ("epub", "mobi", "azw", "azw3"), ("<html", "<!doctype", "<body", "<head")


def reader_of(content: Column, kind: Column) -> Column:
    """Which reader a file (bytes, format) goes to: pdf, book, html or text. A pdf without its mark is a page or a text."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    page = reduce(Column.__or__, [F.lower(head).contains(x) for x in PAGE_SIGNS])
    fake = F.when(page, "html").otherwise("text")
    return F.when(kind == "pdf", F.when(head.startswith("%PDF"), "pdf").otherwise(fake)).when(kind.isin(*BOOKS), "book").otherwise("text")


def extracted(df: DataFrame, content: str = "content", kind: str = "format", most: int = 200_000) -> DataFrame:
    """df plus reader and text: pages and texts are read here (null: no bytes), pdf and book files need a reader of their
    own and have a null text. Bytes are decoded by the ladder once a row."""
    rows = df.withColumn("reader", reader_of(F.col(content), F.lower(F.coalesce(kind, F.lit(""))))).withColumn("_d", decoded(F.col(content), 10 * most))
    text = F.when(F.col("reader") == "html", page_text(F.col("_d"), most)).when(F.col("reader") == "text", F.substring("_d", 1, most))
    return rows.withColumn("text", text).drop("_d")


def clip(pages: DataFrame, width: int = 200) -> DataFrame:
    """url, title, excerpt: the title element, else the first heading, else the url; the start of the text."""
    part = lambda tag: page_text(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    title = F.coalesce(F.nullif(part("title"), F.lit("")), F.nullif(part("h1"), F.lit("")), F.col("url"))
    return pages.select("url", title.alias("title"), F.substring(page_text(F.col("html")), 1, width).alias("excerpt"))
