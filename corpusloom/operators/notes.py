"""Notes from annotations: one note an annotation, one note a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, stripped

#: Ends of lines.
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
#: Kinds of notes, a book without a title, words before and after places.
EXCERPT, REMARK, BOOKMARK, NO_BOOK, SOURCE, CHAPTER, PAGE = "摘录：", "批注：", "书签", "未知书籍", "来源：", "章节 ", ("第 ", " 页")


def quoted(c: Column) -> Column:
    """Every line behind `> `."""
    return F.array_join(F.transform(F.split(c, LINE_END), lambda x: F.concat(F.lit("> "), x)), "\n")


def place_in(anchor: Column) -> Column:
    """struct<chapter, page> of a JSON anchor: whole numbers alone count; wrong types and broken JSON give nulls."""
    v = F.try_parse_json(anchor)
    whole = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "BIGINT", F.try_variant_get(v, f"$.{k}", "bigint"))
    return F.struct(whole("chapter").alias("chapter"), whole("page").alias("page"))


def place_text(chapter: Column, page: Column) -> Column:
    """The chapter (from 0), else the page (from 1), else nothing."""
    return F.when(chapter >= 0, F.concat(F.lit(CHAPTER), chapter)).when(page > 0, F.concat(F.lit(PAGE[0]), page, F.lit(PAGE[1]))).otherwise("")


def blocks(*parts: Column) -> Column:
    """The parts that are not empty, a blank line between them."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def note_title(book: Column, quote: Column, note: Column, most: int = 24) -> Column:
    """《book》 and the first characters of the quote or, without one, of the note; a mark without both is a bookmark."""
    flat = F.trim(F.regexp_replace(F.when(quote != "", quote).otherwise(note), f"(?U){BLANK}+", " "))
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
    kind = F.when(quote != "", F.lit(EXCERPT)).otherwise(F.lit(REMARK))
    return F.concat(F.lit("《"), book, F.lit("》"), F.when(flat == "", F.lit(BOOKMARK)).otherwise(F.concat(kind, cut)))


def notes(annotations: DataFrame, df: DataFrame) -> DataFrame:
    """annotation_id, document_id, title, content of the note of each annotation (id, document_id, quote, note, and
    chapter and page, or the JSON `anchor` that holds them).

    The quote as a block, the note, a link to the document and the place: chapter before page. Annotations of documents
    that are missing or deleted give none.
    """
    if "anchor" in annotations.columns:
        annotations = annotations.withColumn("_p", place_in(F.col("anchor"))).withColumns({"chapter": F.col("_p.chapter"), "page": F.col("_p.page")})
    live = df.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("document_id"), F.col("title").alias("_t"))
    both = annotations.join(live, "document_id").select(
        "id", "document_id", "chapter", "page", stripped(F.col("quote")).alias("_q"), stripped(F.col("note")).alias("_n"),
        F.coalesce(F.nullif(stripped(F.col("_t")), F.lit("")), F.lit(NO_BOOK)).alias("_b"),
    )
    place = place_text(F.col("chapter"), F.col("page"))
    source = F.concat(F.lit(f"{SOURCE}[["), "_b", F.lit("]]"), F.when(place != "", F.concat(F.lit(" · "), place)).otherwise(""))
    quote = F.when(F.col("_q") != "", quoted(F.col("_q"))).otherwise("")
    return both.select(F.col("id").alias("annotation_id"), "document_id", note_title(F.col("_b"), F.col("_q"), F.col("_n")).alias("title"), blocks(quote, F.col("_n"), source).alias("content"))


def daily_sections(annotations: DataFrame, day: str = "day") -> DataFrame:
    """day, book, n, first, section: a day's quotes and notes (id, day, book, quote, note) of one book, in order of id.

    Sections of a day stand in order of `first`, the smallest id. A note of a whole day is its sections one after the
    other; they stay rows, so that no day has to fit into one value.
    """
    own = annotations.select("id", day, F.coalesce(F.nullif("book", F.lit("")), F.lit("未命名文档")).alias("book"), stripped(F.col("quote")).alias("_q"), stripped(F.col("note")).alias("_n"))
    body = blocks(F.when(F.col("_q") != "", quoted(F.col("_q"))).otherwise(""), F.col("_n"))
    rows = own.where("_q <> '' OR _n <> ''").withColumn("_s", F.struct("id", body.alias("body")))
    grouped = rows.groupBy(day, "book").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.array_sort(F.collect_list("_s")).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: x["body"]), "\n\n")
    return grouped.select(day, "book", "n", "first", F.concat(F.lit("### 《[["), "book", F.lit("]]》\n\n"), text).alias("section"))
