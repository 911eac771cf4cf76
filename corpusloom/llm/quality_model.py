"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of the text in UTF-8 (digits as one, control characters and spaces as one), so that no two
characters share one; n-grams are ORDER of them. Trusted text is every document with label quality 1 that isn't
labelled toxic; its n-grams are counted in the tasks and summed by Spark. Lower orders count distinct left neighbours.
Discounts come from the counts of counts; probabilities and back-off weights are joins of each order's counts with
those of its contexts and with the order below.

Scoring joins counts with counts, in shards. The model stays a table of n-grams, dealt out by the last two symbols of an
n-gram's context, so that all that an n-gram may back off to lies in its shard (orders 1 and 2, at most 65,792 n-grams,
lie in every one). Rows of documents are taken in chunks of about CHUNK bytes of text, and a chunk sends its distinct
n-grams, packed, to the shards and gets their values back. Texts meet their chunk's values packed as well. Nothing of
the model is collected or broadcast, and shards hold about SHARD_ROWS n-grams (256 ** 3 at the very most in an n-gram's
hottest pair of symbols, whatever the input).

One in HELD_OUT trusted documents, by the hash of its key, is kept out of the counts and sets the limits: a document is
rejected when its perplexity is above the QUANTILE of its language's held-out documents; languages with fewer than LEAST
of them take the quantile over all held-out documents. Without those nothing is rejected. Quantiles are exact over bins
of 0.001 in log-perplexity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, lean, materialise, small_batches, table
from .tokens import batches, compact

ORDER, BITS, SHARD_ROWS, BROADCAST_IDS, CHUNK, PIECE, LOOKUP = 5, 8, 1_000_000, 1_000_000, 16 << 20, 1 << 19, 4 << 20
QUANTILE, LEAST, HELD_OUT = 0.99, 50, 5
START, SYMBOLS = 1, 1 << BITS

#: The symbol of each byte.
TABLE = np.arange(256, dtype=np.int64)
TABLE[48:58], TABLE[:33] = 48, 32


def symbols(text: str) -> np.ndarray:
    """The text's bytes, digits as 48, bytes up to 32 as 32."""
    return TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all n-grams of all texts, number of them by text); one for each symbol, START before the first."""
    texts = compact(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes, pad = np.diff(ends), order - 1
    flat = np.full(len(data) + pad * len(sizes), START, np.int64)
    real = np.arange(len(data)) + pad * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    flat[real] = TABLE[data]
    code = flat.copy()
    for k in range(1, order):
        code[k:] |= flat[:-k] << (BITS * k) if k < len(flat) else 0
    return code[real], sizes


def count_grams(df: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(code, n) over all texts; null texts have none."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches(source, 1 << 20):
            new, n = np.unique(grams(b.column(0), order)[0], return_counts=True)
            codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
            if len(codes) > SHARD_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return df.select(text).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; half a count where the counts of counts are too few."""
    n = {r.n: r.c for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    if any(n.get(k, 0) < 1 for k in (1, 2, 3, 4)):
        return [0.5, 0.75, 1.0]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]


def fit(trusted: DataFrame, text: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(grams: k, code, logp; contexts: k, code, back), k from 1 to order; both empty without trusted text."""
    mask = lambda k: (1 << (BITS * k)) - 1
    disk = Scratch(trusted.sparkSession, "model")
    counts = {order: disk.keep(count_grams(trusted, text, order), "counts")}
    for k in range(order - 1, 0, -1):
        counts[k] = disk.keep(counts[k + 1].groupBy(F.col("code").bitwiseAND(mask(k)).alias("code")).agg(F.count("*").alias("n")), "counts")
    below, all_grams, all_contexts = None, [], []
    for k in range(1, order + 1):
        d = discounts(counts[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = counts[k].select("code", F.shiftright("code", BITS).alias("ctx"), (F.col("n") - off).alias("rest"), "n", off.alias("off"))
        ctx = own.groupBy("ctx").agg(F.sum("n").alias("whole"), (F.sum("off") / F.sum("n")).alias("gamma"))
        p = own.join(ctx, "ctx").withColumn("suffix", F.col("code").bitwiseAND(mask(k - 1)))
        lower = F.lit(1.0 / SYMBOLS)
        if below is not None:
            p, lower = p.join(below, "suffix"), F.col("low")
        p = p.select("code", (F.col("rest") / F.col("whole") + F.col("gamma") * lower).alias("p"))
        p = disk.keep(p, "grams")
        below = p.select(F.col("code").alias("suffix"), F.col("p").alias("low"))
        all_grams.append(p.select(F.lit(k).alias("k"), "code", F.log("p").cast("float").alias("logp")))
        all_contexts.append(disk.keep(ctx.select(F.lit(k).alias("k"), F.col("ctx").alias("code"), F.log("gamma").cast("float").alias("back")), "contexts"))
    disk.drop(*counts.values())
    return reduce(DataFrame.union, all_grams), reduce(DataFrame.union, all_contexts)


class Model:
    """The fitted tables, which stay tables of Spark, dealt to len() shards by the last two symbols of the context."""

    def __init__(self, grams_: DataFrame, contexts: DataFrame, order: int, shards: int):
        self.grams, self.contexts, self.order, self.shards = grams_, contexts, order, shards

    def __len__(self) -> int:
        return self.shards

    def rows(self) -> DataFrame:
        """(shard, k, code, value): n-grams of order k, and at -k the back-off weights of the contexts of order k."""
        every = F.sequence(F.lit(0), F.lit(self.shards - 1))

        def of(df: DataFrame, sign: int, value: str, shift: int) -> DataFrame:
            pair = F.shiftright("code", shift).bitwiseAND((1 << (2 * BITS)) - 1)
            own = F.shiftright((pair * F.lit(2654435761)).bitwiseAND(0xFFFFFFFF), 16) % self.shards
            place = F.when(F.col("k") <= 2, every).otherwise(F.array(own.cast("int")))
            return df.select(F.explode(place).alias("shard"), (F.lit(sign) * F.col("k")).alias("k"), "code", F.col(value).alias("value"))

        return of(self.grams, 1, "logp", BITS).union(of(self.contexts, -1, "back", 0))

    def shard_of(self, codes: np.ndarray) -> np.ndarray:
        pair = (codes >> BITS) & ((1 << (2 * BITS)) - 1)
        return ((pair * 2654435761 & 0xFFFFFFFF) >> 16) % self.shards


def shards_of(grams_: DataFrame, contexts: DataFrame, order: int = ORDER, rows: int = SHARD_ROWS) -> Model:
    """The model in shards of about `rows` n-grams; one more for each `rows` of them."""
    return Model(grams_, contexts, order, min(1 << (2 * BITS), max(1, -(-grams_.count() // rows))))


def values_of(codes: np.ndarray, rows: pa.Table, order: int) -> np.ndarray:
    """log p of each code from one shard's rows: an n-gram's own value, or back-off weight and that of its suffix."""
    k, code, value = (rows.column(c).to_numpy() for c in ("k", "code", "value"))

    def found(level: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(k == level)
        by = own[np.argsort(code[own], kind="stable")]
        if not len(by):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        at = by[np.minimum(np.searchsorted(code[by], asked), len(by) - 1)]
        return code[at] == asked, value[at].astype(np.float64)

    out, left, now = np.zeros(len(codes)), np.arange(len(codes)), codes
    for n in range(order, 0, -1):
        there, logp = found(n, now)
        out[left[there]] += logp[there]
        left, now = left[~there], now[~there]
        there, back = found(-n, now >> BITS)
        out[left] += np.where(there, back, 0.0)
        now = now & ((1 << (BITS * (n - 1))) - 1)
    out[left] -= math.log(SYMBOLS)
    return out


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def in_chunks(source: Iterator[pa.RecordBatch], place: int, chunk: int = CHUNK, piece: int = PIECE) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows): a partition's rows in chunks of about `chunk` bytes of text, in pieces of about `piece` bytes.

    A chunk's number depends on the partition and the text bytes before a row in it alone, not on Arrow's batches.
    """
    held, task = 0, TaskContext.get().partitionId() << 32
    for b in source:
        size = pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = held + np.cumsum(size) - size
        held += int(size.sum())
        mark = before // chunk * (1 << 20) + before % chunk // piece
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield task + int(before[lo] // chunk), b.slice(lo, hi - lo)


def chunk_codes(df: DataFrame, text: str, model: Model, chunk: int = CHUNK) -> DataFrame:
    """(_chunk, shard, n, codes): for each chunk and shard its distinct n-grams, sorted and packed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at: int, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = model_shards(codes)
            for s in np.unique(shard):
                own = codes[shard == s]
                cols = [pa.array([at], pa.int64()), pa.array([s], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([packed(np.diff(own, prepend=0))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["_chunk", "shard", "n", "codes"])

        now, held = None, []
        for at, b in in_chunks(source, 0, chunk):
            if now is not None and at != now:
                yield from done(now, np.unique(np.concatenate(held)))
                held = []
            now = at
            held.append(np.unique(grams(b.column(0), order)[0]))
            if len(held) > 8:
                held = [np.unique(np.concatenate(held))]
        if now is not None:
            yield from done(now, np.unique(np.concatenate(held)))

    model_shards, order = Model(None, None, model.order, model.shards).shard_of, model.order
    return df.select(text).mapInArrow(lean(run), "_chunk long, shard int, n long, codes binary")


def chunk_values(codes: DataFrame, model: Model, lookup: int = LOOKUP) -> DataFrame:
    """codes plus values (packed log p). A shard's chunks are split so that a task gets about `lookup` bytes of them."""
    size = codes.agg(F.sum(F.length("codes"))).first()[0] or 0
    parts, order = max(1, -(-size // (lookup * model.shards))), model.order
    left = model.rows().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = codes.withColumn("part", F.pmod(F.xxhash64("_chunk"), F.lit(parts)).cast("int"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        n = asked.column("n").to_pylist()
        every = [np.cumsum(unpacked(x.as_py(), k, np.int64)) for x, k in zip(asked.column("codes"), n, strict=True)]
        whole, back = np.unique(np.concatenate([*every, np.zeros(0, np.int64)]), return_inverse=True)
        got = values_of(whole, rows, order).astype(np.float32)[back]
        ends = np.append(0, np.cumsum(n)).astype(np.int64)
        blobs = pa.array([packed(got[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
        pa.default_memory_pool().release_unused()
        return asked.select(["_chunk", "n", "codes"]).append_column("values", blobs)

    both = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part"))
    return both.applyInArrow(run, "_chunk long, n long, codes binary, values binary")


def perplexities(df: DataFrame, model: Model, text: str = "text", chunk: int = CHUNK, names: tuple[str, str] = ("logp", "n_symbols")) -> DataFrame:
    """df plus logp double and n_symbols long (`names`); null and empty texts have 0 of both. Columns of these names are replaced.

    df is read twice, and its partitions have to hold the same rows both times, as those of files do; else write it
    first (an n-gram without a value is an error, never a wrong sum). A very long text is a chunk's piece of its own.
    """
    df = df.drop(*names)
    place, order, schema = df.columns.index(text), model.order, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    small_batches(df.sparkSession)
    disk = Scratch(df.sparkSession, "perplexities")
    codes = disk.keep(chunk_codes(df, text, model, chunk), "codes")
    values = disk.keep(chunk_values(codes, model), "values")
    disk.drop(codes)

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in in_chunks(source, place, chunk):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_chunk", "rows"])

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        n = own.column("n").to_pylist()
        code = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(x.as_py(), k, np.int64)) for x, k in zip(own.column("codes"), n, strict=True))])
        value = np.concatenate([np.zeros(0, np.float32), *(unpacked(x.as_py(), k, np.float32) for x, k in zip(own.column("values"), n, strict=True))])
        by = np.argsort(code)
        code, value, out = code[by], value[by].astype(np.float64), []
        for blob in rows.column("rows"):
            for b in pa.ipc.open_stream(blob.as_buffer()):
                asked, sizes = grams(b.column(place), order)
                at = np.searchsorted(code, asked)
                if len(asked) and (at.max() >= len(code) or (code[at] != asked).any()):
                    raise ValueError("n-grams of a chunk without a value: df gave other rows the second time")
                sums, ends = np.append(0.0, np.cumsum(value[at])), np.append(0, np.cumsum(sizes))
                cols = [*b.columns, pa.array(sums[ends[1:]] - sums[ends[:-1]]), pa.array(sizes)]
                out.append(pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out) if out else empty

    kinds = df.limit(0).toArrow().schema
    empty = pa.schema([*kinds, pa.field(names[0], pa.float64()), pa.field(names[1], pa.int64())]).empty_table()
    both = df.mapInArrow(lean(pack), "_chunk long, rows binary").groupBy("_chunk").cogroup(values.groupBy("_chunk"))
    return both.applyInArrow(run, f"{schema}, `{names[0]}` double, `{names[1]}` long")


def score_of(logp: str = "logp", n: str = "n_symbols") -> Column:
    """Log-perplexity; an empty text has 0."""
    return F.when(F.col(n) > 0, -F.col(logp) / F.col(n)).otherwise(0.0)


def thresholds(trusted: DataFrame, lang: str = "lang", quantile: float = QUANTILE, least: int = LEAST) -> tuple[DataFrame, float | None]:
    """((lang, limit): log-perplexity at each language's quantile, the same over all); from rows with lang and score."""
    bins = trusted.select(F.coalesce(lang, F.lit("")).alias("lang"), F.round("score", 3).alias("score")).groupBy("lang", "score").agg(F.count("*").alias("n"))
    bins = materialise(bins, "bins")

    def at_quantile(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        run = df.withColumns({"up": F.sum("n").over(w.orderBy("score")), "all": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        return run.where(F.col("up") >= quantile * F.col("all")).groupBy(*by).agg(F.min("score").alias("limit"), F.max("all").alias("all"))

    own = materialise(at_quantile(bins, ["lang"]).where(F.col("all") >= least).select("lang", "limit"), "limits")
    whole = at_quantile(bins.groupBy("score").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("")), ["lang"]).collect()
    return own, whole[0]["limit"] if whole else None


def trusted_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents labelled quality 1 and not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, key, "left_semi")


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, reference: DataFrame | None = None,
    names: tuple[str, str, str] = ("perplexity", "threshold", "kept"), quantile: float = QUANTILE,
) -> DataFrame:
    """docs plus perplexity double, threshold double and kept boolean (`names`); one row per input row.

    Empty and null texts have perplexity 1 and are kept: there is nothing in them to judge. Null languages are a
    language of their own. Trusted documents are taken from `reference` (default: docs). Repeated rows are judged each.
    Columns of the three names are replaced, all others stay, whatever their names. An empty docs gives no rows, empty
    labels reject nothing. docs is read several times (see perplexities).
    """
    docs = docs.drop(*names)
    trusted = trusted_of(reference if reference is not None else docs, labels, key).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(HELD_OUT)) == 0
    grams_, contexts = fit(trusted.where(~held), "text", order)
    model = shards_of(grams_, contexts, order)
    scored = perplexities(trusted.where(held), model).select("lang", score_of().alias("score")).where("score > 0")
    limits, whole = thresholds(scored, "lang", quantile)
    logp, n, own, limit = free_names(docs, "logp", "n", "lang", "limit")
    out = perplexities(docs, model, text, names=(logp, n)).withColumn(own, F.coalesce(lang, F.lit("")))
    out = out.join(limits.select(F.col("lang").alias(own), F.col("limit").alias(limit)), own, "left")  # one row a language
    level, most = score_of(logp, n), F.coalesce(F.col(limit), F.lit(whole).cast("double"))
    return out.select(*docs.columns, F.exp(level).alias(names[0]), F.exp(most).alias(names[1]), F.coalesce(level <= most, F.lit(True)).alias(names[2]))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")
