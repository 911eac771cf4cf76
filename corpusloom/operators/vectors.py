"""Vector scoring over given embeddings, rank fusion, retrieval measures, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters after which a chunk may end.
ENDINGS = "。！？；.!?;"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def exact_top(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 1000) -> DataFrame:
    """query_id, vec_id, score, rank: exact scan for all queries.

    Vectors are packed into chunks of CHUNK, queries into blocks of about `most_queries`; a chunk and a block meet as two
    rows, a matrix product leaves those that may be among a query's k best of the chunk, and only their scores, summed in
    the order of `dot`, are shuffled. So shuffled rows are k for each query and chunk, not one for each pair; the products
    are all pairs, spread over the chunks. Vectors without finite components of the usual number go pair by pair.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    n, width = asked.agg(F.count("*"), F.mode(F.size("_q"))).first()
    usual = lambda c: (F.size(c) == (width or 0)) & F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False))), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull())
    plain, odd = rows.where(usual("embedding")), rows.where(~F.coalesce(usual("embedding"), F.lit(False)))
    blocks = max(1, -(-n // most_queries))
    whole = asked.where(usual("_q")).repartition(blocks)
    packed, sides = _packed(whole, "query_id", "_q", width or 0, most_queries), max(1, (n * (width or 0) * 8) >> 26)
    pairs = _packed(plain, "vec_id", "embedding", width or 0, CHUNK).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    pairs = pairs.crossJoin(F.broadcast(packed) if sides == 1 else packed)
    kind, of = asked.schema["query_id"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    near = pairs.select("query_id_s", "_q_s", "vec_id_s", "embedding_s").mapInArrow(_nearest(width or 0, k), f"query_id {kind}, vec_id {of}, score double")

    def each(v: DataFrame, q: DataFrame) -> DataFrame:
        return v.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", dot(F.col("embedding"), F.col("_q")).alias("score"))

    scored = near.unionByName(each(odd, asked)).unionByName(each(plain, asked.where(~F.coalesce(usual("_q"), F.lit(False)))))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Vectors that meet a block of queries at once, and the entries of a matrix of scores.
CHUNK, ENTRIES = 8_192, 1 << 20


def _packed(df: DataFrame, key: str, vector: str, width: int, most: int) -> DataFrame:
    """key_s (array), vector_s (binary, little-endian doubles): up to `most` rows of a partition in one. No vector is null."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in source:
            while b.num_rows:
                part, b = b.slice(0, most - n), b.slice(most - n)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = pa.concat_arrays([b.column(0) for b in held])
        data = b"".join(b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes() for b in held)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([data], pa.binary())], names=[f"{key}_s", f"{vector}_s"])

    return df.select(key, vector).mapInArrow(run, f"{key}_s array<{df.schema[key].dataType.simpleString()}>, {vector}_s binary")


def _nearest(width: int, k: int):
    """For mapInArrow over pairs of a block and a chunk: query_id, vec_id, score of each query's k best in the chunk."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i in range(b.num_rows):
                yield from pair(b.column(0)[i].values, b.column(1)[i].as_py(), b.column(2)[i].values, b.column(3)[i].as_py())

    def pair(asked: pa.Array, q: bytes, ids: pa.Array, v: bytes) -> Iterator[pa.RecordBatch]:
        q, v = np.frombuffer(q, "<f8").reshape(-1, width), np.frombuffer(v, "<f8").reshape(-1, width)
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        codes = np.asarray(pa.concat_arrays([asked, ids.cast(asked.type)]).dictionary_encode().indices.fill_null(-1))
        own, other = codes[: len(asked)], codes[len(asked) :]
        # a product in another order of summation differs from the sum in order by less than this
        slack = 4 * (width + 2) * 2.0**-52 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max(initial=0))
        for lo in range(0, len(q), step := max(1, ENTRIES // len(v))):
            about = q[lo : lo + step] @ v.T
            about[own[lo : lo + step, None] == other] = -np.inf
            best = np.partition(about, -k, axis=1)[:, -k] if len(v) > k else np.full(len(about), -np.inf)
            row, col = np.nonzero((about >= (best - slack[lo : lo + step])[:, None]) & (about > -np.inf))
            score = np.zeros(len(row))
            for d in range(width):
                score += v[col, d] * q[lo + row, d]
            by = np.lexsort((place[col], -score, row))
            row, col, score = row[by], col[by], score[by]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = pa.array(lo + row[first]), pa.array(col[first])
            yield pa.RecordBatch.from_arrays([asked.take(row), ids.take(col), pa.array(score[first])], names=["query_id", "vec_id", "score"])

    return run


def fuse(ranked: DataFrame, query: str = "query_id", item: str = "item", rank: str = "rank", constant: int = 60) -> DataFrame:
    """query, item, rrf: the sum of 1 / (constant + rank) over all ranked lists (one row an item and list)."""
    return ranked.groupBy(query, item).agg(F.sum(1.0 / (constant + F.col(rank))).alias("rrf"))


def precision(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hits, precision of the first k by judged pairs (query_id, item)."""
    judged = ranked.where(F.col("rank") <= k).join(relevant.withColumn("_r", F.lit(1)), ["query_id", "item"], "left")
    return judged.groupBy("query_id").agg(F.count("_r").alias("hits"), (F.count("_r") / F.lit(float(k))).alias("precision"))


def by_document(ranked: DataFrame, document: str, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """query, document, rank: documents in the order of their first chunk, numbered from 1."""
    first = ranked.groupBy(query, document).agg(F.min(rank).alias("_r"))
    return first.select(query, document, F.row_number().over(Window.partitionBy(query).orderBy("_r", document)).alias(rank))


def retrieval_quality(ranked: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """query_id, hits, precision of every judged query: those without a result have 0. judged: query_id, item."""
    found = precision(ranked, judged, k)
    return judged.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def compared(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: queries, mean precision of both, and the queries where the new one is better, as good, not worse."""
    both = new.join(old.select("query_id", F.col("precision").alias("_o")), "query_id")
    p, o = F.col("precision"), F.col("_o")
    return both.agg(
        F.count("*").alias("queries"), F.avg(p).alias("mean_new"), F.avg(o).alias("mean_old"),
        F.count_if(p > o).alias("better"), F.count_if(p == o).alias("equal"), F.count_if(p >= o).alias("not_worse"),
    )


def chunk_statistics(counted: DataFrame, most: int = 200) -> DataFrame:
    """One row over documents (n: chunks): documents, chunks, mean, median, largest, and how many reach `most`."""
    return counted.agg(
        F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.avg("n").alias("mean"), F.median("n").alias("median"),
        F.max("n").alias("largest"), F.count_if(F.col("n") >= most).alias("capped"),
    )


def chunk_count(length: Column, step: int = 680, most: int = 200) -> Column:
    return F.least(F.ceil(length / float(step)), F.lit(most)).cast("long")


def chunks(df: DataFrame, key: str = "id", text: str = "content", width: int = 800, overlap: int = 120, least: int = 200) -> DataFrame:
    """key, idx, chunk: windows of `width` characters every width - overlap; texts below `least` give none."""
    step = width - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(float(step))).cast("int") - 1))
    cut = df.where(n >= least).select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("idx", "_s"))
    return cut.select(key, "idx", F.substring("_t", F.col("_s") * step + 1, F.lit(width)).alias("chunk"))


def tidy(c: Column) -> Column:
    """One line end, one blank for runs of blanks, at most one empty line, no white space at the ends; null is empty."""
    for pattern, by in (("\r\n?", "\n"), (r"[ \t\u00a0\u3000]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(F.coalesce(c, F.lit("")), pattern, by)
    return c


def cut_chunks(df: DataFrame, key: str = "id", text: str = "content", width: int = 800, overlap: int = 120, tail: int = 200, least: int = 200, most: int = 200) -> DataFrame:
    """key, idx, chunk: windows over the tidied text that end at the last ENDINGS character of their last `tail` ones, if any.

    Each window starts `overlap` characters before the end of the one before, so the places depend on one another and
    the cut is a Python function. Texts below `least` give none; `most` windows a text at most, as the feature asks.
    """

    def cut(whole: str) -> list[str]:
        out, start = [], 0
        while len(out) < most:
            end = start + width
            if end < len(whole):
                last = max(whole.rfind(x, end - tail, end) for x in ENDINGS)
                end = last + 1 if last >= 0 else end
            out.append(whole[start:end].strip())
            if end >= len(whole):
                break
            start = max(end - overlap, start + 1)
        return [x for x in out if x]

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(cut)

    tidied = df.select(key, tidy(F.col(text)).alias("_t")).where(F.length("_t") >= least)
    return tidied.select(key, F.posexplode(pieces("_t")).alias("idx", "chunk"))


def hybrid(by_vector: DataFrame, by_text: DataFrame, depth: int = 5, query: str = "query_id", item: str = "item", rank: str = "rank", constant: int = 60) -> DataFrame:
    """query, item, rrf, rank: both lists cut to `depth`, fused, the best `depth` again; ties by item."""
    first = lambda df: df.select(query, item, rank).where(F.col(rank) <= depth)
    fused = fuse(first(by_vector).unionByName(first(by_text)), query, item, rank, constant)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rrf"), item))
    return fused.withColumn(rank, place).where(F.col(rank) <= depth)
