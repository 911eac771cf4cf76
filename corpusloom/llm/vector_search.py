"""Approximate nearest neighbours by an adaptive dimension scan inside probed lists.

Index: k-means centroids (Spark ML, fitted on at most SAMPLE vectors) deal every vector to a list; a list is stored in
chunks of about CHUNK vectors, so that a list with a third of all rows is many rows, not one. A chunk holds its vectors
twice: as given, and turned by one random rotation and laid out in column blocks of STEP dimensions.
Search: a query goes to its nearest lists. In a chunk, the first vectors give a threshold, the k-th best distance so
far; all others are read block by block, and after each block a vector is abandoned when its partial distance is too
large for its whole distance to be below the threshold: after a random rotation, d of D dimensions hold about d / D of
the squared distance, and the test allows for an error of EPSILON / sqrt(d). Survivors are measured exactly, in double
precision on the vectors as given. The best k of all chunks are the answer.

How many lists are probed is fitted on the sample: the least number that holds TARGET of the true neighbours of
CALIBRATION sampled queries. Broadcast: centroids and the rotation, both bounded by parameters and the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

LIST_ROWS, MOST_LISTS, SAMPLE, CALIBRATION, TARGET = 512, 4096, 20_000, 300, 0.97
CHUNK, QUERY_CHUNK, FIRST, STEP, EPSILON = 2048, 512, 64, 16, 2.1


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v array<double>): vectors that take part. Null, zero, or with null or non-finite components do not.

    The dimension is the commonest one (ties: the smallest); vectors of another one have no distance and take no part.
    Null keys take no part.
    """
    v = F.col(vector)
    ok = df.where(v.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), v.cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = ok.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("v") == (common["d"] if common else 0))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def fit_lists(vectors: DataFrame, n: int, k: int = 10) -> tuple[np.ndarray, int]:
    """(centroids, number of lists to probe), from a sample of at most SAMPLE vectors."""
    lists = max(1, min(MOST_LISTS, -(-n // LIST_ROWS)))
    sample = vectors.sample(min(1.0, 1.05 * SAMPLE / n), 5).limit(SAMPLE) if n > SAMPLE else vectors
    sample = materialise(sample, "sample")
    x = np.stack([np.array(r.v) for r in sample.select("v").collect()])
    centres = x.mean(0)[None]
    if lists > 1:
        means = KMeans(k=lists, seed=1, maxIter=8, initSteps=1, featuresCol="f")
        centres = np.array(means.fit(sample.select(array_to_vector("v").alias("f"))).clusterCenters())
    q = x[np.random.default_rng(2).permutation(len(x))[:CALIBRATION]]
    near = np.argsort(squared(q, x), 1)[:, : k + 1]
    order = np.argsort(squared(q, centres), 1)
    place = np.argsort(order, 1)
    at = np.sort(np.take_along_axis(place, squared(x, centres).argmin(1)[near], 1).ravel())
    return centres, int(at[min(len(at) - 1, math.ceil(TARGET * len(at)))]) + 1


def packed(df: DataFrame, names: tuple[str, str], turn=None) -> DataFrame:
    """One row a (list, part): ids and vectors of its rows as binary and, with a rotation, the column blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("key").to_numpy().astype(np.int64)
        x = np.array(rows.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        cols = [pa.array([key[0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
        if turn is not None:
            y = (x @ turn.value).astype(np.float32).T
            cols.append(pa.array([[np.ascontiguousarray(y[i : i + STEP]).tobytes() for i in range(0, len(y), STEP)]], pa.list_(pa.binary())))
        return pa.Table.from_arrays(cols, names=["list", *names, *["blocks"] * (turn is not None)])

    return df.groupBy("list", "part").applyInArrow(run, f"list int, {names[0]} binary, {names[1]} binary" + ", blocks array<binary>" * (turn is not None))


def scan(q: np.ndarray, turned: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of one chunk found by the adaptive dimension scan, ties to smaller ids."""

    def exact(at: np.ndarray) -> np.ndarray:
        d = x[at] - q
        return np.sqrt((d * d).sum(1))

    head = np.flatnonzero(ids[:FIRST] != own)
    best, score = head, exact(head)
    if len(ids) > FIRST:
        limit = np.partition(score, k - 1)[k - 1] ** 2 if len(score) >= k else np.inf
        alive = np.arange(FIRST, len(ids))
        part, done, whole = np.zeros(len(alive)), 0, len(q)
        for b in blocks:
            d = b[:, alive].astype(np.float64) - turned[done : done + len(b), None]
            part = part + (d * d).sum(0)
            done += len(b)
            slack = (1 + EPSILON / math.sqrt(done)) ** 2 if done < whole else 1.0
            keep = part <= limit * done / whole * slack + 1e-5 * (1 + limit if limit < np.inf else 1)
            alive, part = alive[keep], part[keep]
        alive = alive[ids[alive] != own]
        best, score = np.concatenate([best, alive]), np.concatenate([score, exact(alive)])
    by = np.lexsort((ids[best], score))[:k]
    return ids[best[by]], score[by]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score double: the k nearest rows of df found for each query.

    Euclidean distance in double precision, ties to the smaller id; a row is no candidate of a query of its own id.
    Vectors that are null, zero, or hold null or non-finite components take no part on either side (see sound); a query
    with fewer than k candidates gets all that are found. Equal ids on several rows are candidates each. An empty df,
    or one without sound vectors, gives no rows. Other columns of df and queries are ignored. `probes` sets the number
    of lists searched; all lists make the search miss only what the tests abandon.
    """
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    base = materialise(sound(df, key, vector), "vectors")
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], out)
    centres, fitted = fit_lists(base, n, k)
    dim, wanted = centres.shape[1], min(len(centres), probes or fitted)
    asked = sound(queries, key, vector).where(F.size("v") == dim)
    turn, middle = spark.sparkContext.broadcast(rotation(dim)), spark.sparkContext.broadcast(centres)

    def listed(count: int):
        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                if b.num_rows:
                    x = np.array(b.column(1).flatten()).reshape(b.num_rows, -1)
                    d = (middle.value**2).sum(1)[None] - 2 * x @ middle.value.T
                    found = d.argmin(1)[:, None] if count == 1 else np.argpartition(d, count - 1, 1)[:, :count]
                    at = pa.array(np.repeat(np.arange(b.num_rows), count))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["list", "key", "v"])

        return run

    def parts(part: DataFrame, most: int) -> DataFrame:
        sizes = part.groupBy("list").agg(F.ceil(F.count("*") / most).alias("parts"))  # one row a list
        return part.join(F.broadcast(sizes), "list").select("list", "key", "v", F.pmod(F.xxhash64("key", "v"), F.col("parts")).alias("part"))

    kind = "list int, key long, v array<double>"
    index = materialise(packed(parts(materialise(base.mapInArrow(listed(1), kind), "listed"), CHUNK), ("ids", "vectors"), turn), "index")
    probed = materialise(asked.mapInArrow(listed(wanted), kind), "probed")
    blocks = packed(parts(probed, QUERY_CHUNK), ("query_ids", "queries"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i in range(b.num_rows):
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_py(), t)  # noqa: E731, B023
                ids, qs = get("ids", np.int64), get("query_ids", np.int64)
                x, y = get("vectors", np.float64).reshape(len(ids), dim), get("queries", np.float64).reshape(len(qs), dim)
                laid = [np.frombuffer(c, np.float32).reshape(-1, len(ids)) for c in b.column("blocks")[i].as_py()]
                turned = (y @ turn.value).astype(np.float32).astype(np.float64)
                found = [scan(y[j], turned[j], int(qs[j]), ids, x, laid, k) for j in range(len(qs))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qs, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    pairs = index.join(blocks, "list").select("ids", "vectors", "blocks", "query_ids", "queries")
    found = pairs.repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64("ids", "query_ids")).mapInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
