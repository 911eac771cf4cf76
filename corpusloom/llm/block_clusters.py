"""Centroid clustering of integer vectors with block-norm screening: exact assignments, few whole distances.

Every vector is written once, as integers, with its block vector: the Euclidean norms of the positive and of the
negative components of each segment of SEGMENT dimensions. By Cauchy-Schwarz, the inner product of two vectors is at
most that of their block vectors (products of unlike signs are not above 0), so |v|^2 + |c|^2 minus twice the block
vectors' product bounds the squared distance from below at a quarter of the work. A vector is measured exactly against
the centroid of the smallest bound, then only against those whose bound isn't above the best exact distance so far.
Bounds are doubles, lowered by more than their rounding; distances are integers, so the result is that of a plain scan.

Each round is one scan of the written table. A task gives one row of sums a cluster, Spark adds them up, and centroids
(K of them) are all that the driver holds or ships.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, table

K, ROUNDS, DIMS, SCALE, SEGMENT = 40, 5, 64, 256, 8
#: Largest size of a component as an integer: then a squared distance of DIMS components fits a long.
MOST = 1 << 27


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(scale * x))


def sound(df: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key long, v array<bigint>) of the vectors that take part: exactly `dims` components, none null or non-finite.

    Null keys take no part, nor do vectors with a component of MOST / scale or more in size: their squared distances
    may not fit a long.
    """
    v = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST // scale)
    ok = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where((F.size(vector) == dims) & F.forall(v, fine))
    return ok.select(F.col(key).cast("long").alias("key"), integers(F.col(vector), scale).alias("v"))


def block_vectors(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norms of the positive and of the negative components of each segment."""
    parts = x.astype(np.float64)
    cut = np.arange(0, x.shape[1], segment)
    both = [np.add.reduceat(np.square(np.maximum(s * parts, 0)), cut, 1) for s in (1, -1)]
    return np.sqrt(np.concatenate(both, 1))


def screened(x: np.ndarray, blocks: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance, exact distances taken); ties to the smaller number."""
    own = block_vectors(centres)
    a, b = np.square(blocks).sum(1)[:, None], np.square(own).sum(1)[None]
    low = a + b - 2 * (blocks @ own.T) - (1e-9 * (a + b) + 1)  # far more than the rounding of the bound
    first = low.argmin(1)

    def exact(rows: np.ndarray, at) -> np.ndarray:
        d = x[rows] - centres[at]
        return np.einsum("ij,ij->i", d, d)

    best, near, taken = exact(np.arange(len(x)), first), first.copy(), len(x)
    for j in range(len(centres)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = exact(rows, j)
        taken += len(rows)
        won = (d < best[rows]) | ((d == best[rows]) & (j < near[rows]))
        best[rows[won]], near[rows[won]] = d[won], j
    return near, best, taken


def _matrix(c: pa.Array, kind, n: int) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(n, -1)


def written(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """key, v binary (32-bit integers), blocks binary (doubles), written once."""

    @lean
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                kept = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype(np.int32), block_vectors(x))]
                yield pa.RecordBatch.from_arrays([b.column(0), *kept], names=["key", "v", "blocks"])

    return scratch.keep(vectors.mapInArrow(run, "key long, v binary, blocks binary"), "vectors")


def _screen(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    x = _matrix(b.column("v"), np.int32, b.num_rows).astype(np.int64)
    return (x, *screened(x, _matrix(b.column("blocks"), np.float64, b.num_rows), centres))


def sums(vectors: DataFrame, centres: np.ndarray) -> dict[int, list[int]]:
    """Cluster -> sums of its vectors' components and, last, their number. K x (dims + 1) values come to the driver."""

    @lean
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), centres.shape[1] + 1), np.int64)
        for b in source:
            if b.num_rows:
                x, near, _, _ = _screen(b, centres)
                for j in np.unique(near):
                    total[j, :-1] += x[near == j].sum(0)
                    total[j, -1] += (near == j).sum()
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = vectors.select("v", "blocks").mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("i", "x"))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("cluster", "i").collect():
        out.setdefault(r["cluster"], []).append(int(r["x"]))
    return out


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """key, cluster int, distance long (squared)."""

    @lean
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            if b.num_rows:
                _, near, best, _ = _screen(b, centres)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(near.astype(np.int32)), pa.array(best)], names=["key", "cluster", "distance"])

    return vectors.mapInArrow(run, "key long, cluster int, distance long")


def clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((key, cluster int, distance long), centroids): one row per vector that takes part (see sound).

    Centroids start as the k vectors with the smallest sha256 of seed and key (equal keys: smaller components first; all
    vectors, if fewer), and are replaced `rounds` times by the exact floor of their vectors' means; empty ones stay.
    Repeated rows are vectors of their own. Without vectors there are no rows and no centroids. Other columns of df are
    ignored.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    vectors = sound(df, key, vector)
    first = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256), "v").limit(k).select("v").collect()
    centres = np.array([r["v"] for r in first], np.int64).reshape(len(first), DIMS)
    if not len(centres):
        return df.sparkSession.createDataFrame([], "key long, cluster int, distance long").withColumnRenamed("key", key), centres
    kept = written(scratch, vectors)
    for _ in range(rounds):
        for j, (*total, n) in sums(kept, centres).items():
            centres[j] = [s // n for s in total]
    return scratch.keep(assigned(kept, centres), "assigned").withColumnRenamed("key", key), centres


def op11_block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centres = clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    own = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # K rows
    rows = [(j, d, sum(own.values()), hashlib.sha256(",".join(map(str, centres[j].tolist())).encode()).hexdigest()) for j, d in own.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """Assignment i as SQL, and the centroids after it."""
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(CAST({square} AS BIGINT) * {K} + c.j) AS m FROM v, c{i} c GROUP BY vec_id),
m{i} AS (SELECT j, list({floor} ORDER BY i) AS q FROM (SELECT m % {K} AS j, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j),"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT j, q FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, q FROM v) WHERE j < {K}),{"".join(map(_round, range(ROUNDS + 1)))}
f AS (SELECT vec_id, m % {K} AS j, m // {K} AS d FROM a{ROUNDS})
SELECT vec_id, CAST(f.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON c.j = f.j
"""
