"""A positional inverted index as Parquet, and phrase search, BM25 and ranking from its lists alone.

Build: documents are taken in parts (PART_ROWS documents or PART_CHARS characters, a longer one alone). A part gives one
row for each term and field: which of its documents hold the term, their keys and sizes, how often and where. A part's
rows are sorted by term and written where they are made, dealt by term into SHARDS folders that a task holds open at
once, so without a shuffle or a sort of rows. A query prunes to the folders of its terms and, by Parquet's page index
(pages of PAGE_ROWS), to their pages. A term that a third of all documents hold is a row a part, never one row.

Search: the lists of a phrase's terms are joined by part, where all rows of a document meet, and their places are
intersected (term at p, next term at p + offset). What comes out is one row a document with its counts by phrase and
field; frequencies are one small aggregate of it, scores need no shuffle, the best k are taken by Spark's top-k. No body
is read. Changes are generations: see `apply_changes`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.workspace import exists, once
from .search import K1, B

SHARDS, PART_ROWS, PART_CHARS, PAGE_ROWS = 16, 2_000, 1 << 20, 500
#: The row of a part that lists its documents has this field and no term; it lies in the folder of this shard.
DOCS = -1
#: Ideographs, extension A and compatibility ideographs.
CJK = "㐀-䶿一-鿿豈-﫿"
_RUN = re.compile(rf"[{CJK}]+|[^\s{CJK}]+")
_IDEOGRAPH = re.compile(f"[{CJK}]")
#: Titles that are broadcast at most.
BROADCAST_BYTES = 32 << 20
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


@dataclass(frozen=True)
class Grams:
    """Every n characters in a row (n up to 3) of the lower-cased text; a phrase is found wherever it stands."""

    n: int = 3

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(term number, document, place) of every term of the texts in their order, and the terms by number."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
        size = np.array([max(0, len(p) - self.n + 1) for p in points])
        codes = [sum(p[k : len(p) - self.n + 1 + k] << 21 * (self.n - 1 - k) for k in range(self.n)) if len(p) >= self.n else p[:0] for p in points]
        values, number = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_inverse=True)
        terms = ["".join(chr((v >> 21 * (self.n - 1 - k)) & 0x1FFFFF) for k in range(self.n)) for v in values.tolist()]
        return number, np.repeat(np.arange(len(texts)), size), np.concatenate([*map(np.arange, size), np.empty(0, np.int64)]), terms

    def cover(self, phrase: str) -> list[tuple[str, int]]:
        """Terms with offsets that together hold every character of the phrase; [] if it is too short for the index."""
        low = phrase.lower()
        last = len(low) - self.n
        return [(low[i : i + self.n], i) for i in dict.fromkeys([*range(0, last + 1, self.n), last])] if last >= 0 else []


@dataclass(frozen=True)
class Runs:
    """Ideographs, two in a row, and whole lower-cased runs of other characters.

    A phrase of ideographs is found wherever it stands; other text only by whole runs between blanks and ideographs. A blank
    of a phrase stands for any white space of its length.
    """

    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        for run in _RUN.finditer(text):
            s, at = run.group(), run.start()
            if _IDEOGRAPH.match(s):
                for i in range(len(s)):
                    yield s[i], at + i
                    if i + 1 < len(s):
                        yield s[i : i + 2], at + i
            else:
                yield s, at

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """As Grams.places, terms in their order: what tokens() gives for each text, for all texts at once."""
        whole = "\n".join([*texts, ""])
        p = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = [(ord(CJK[i]), ord(CJK[i + 2])) for i in range(0, len(CJK), 3)]
        ideograph = np.logical_or.reduce([(p >= lo) & (p <= hi) for lo, hi in bounds])
        other = np.r_[False, ~ideograph & ~np.isin(p, _BLANKS), False]
        first, end = np.flatnonzero(other[1:] & ~other[:-1]), np.flatnonzero(~other[1:] & other[:-1])
        one = np.flatnonzero(ideograph)
        two = one[np.append(ideograph, False)[one + 1]]
        short = end - first <= 3
        at = np.concatenate([one, two, first[short]])
        size = np.concatenate([np.ones(len(one), int), np.full(len(two), 2), (end - first)[short]])
        p = np.append(p, [0, 0])
        codes = sum(np.where(size > k, (p[at + k] + 1) << 21 * (2 - k), 0) for k in range(3))  # points plus one, 0 is no character
        values, number = np.unique(codes, return_inverse=True)
        terms = ["".join(chr(x - 1) for k in range(3) if (x := (v >> 21 * (2 - k)) & 0x1FFFFF)) for v in values.tolist()]
        known: dict[str, int] = {}
        more = [known.setdefault(whole[i:j], len(terms) + len(known)) for i, j in zip(first[~short].tolist(), end[~short].tolist(), strict=True)]
        terms += known
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        number, at = rank[np.concatenate([number, np.array(more, np.int64)])], np.concatenate([at, first[~short]])
        doc = np.searchsorted(starts, at, "right") - 1
        return number, doc, at - starts[doc], [terms[i] for i in order]

    def cover(self, phrase: str) -> list[tuple[str, int]]:
        out = []
        for run in _RUN.finditer(phrase.lower()):
            s, at = run.group(), run.start()
            pairs = [(s[i : i + 2], at + i) for i in dict.fromkeys([*range(0, len(s) - 1, 2), len(s) - 2])]
            out += pairs if len(s) > 1 and _IDEOGRAPH.match(s) else [(s, at)]
        return out


def shard_of(term: str, shards: int = SHARDS) -> int:
    return zlib.crc32(term.encode()) % shards


def _parts(source: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple[list, list[int], list[list[str]]]]:
    """(keys, sizes, texts by field) in parts; columns are the key, the size and the fields' lower-cased texts."""
    keys, sizes, texts, chars = [], [], [[] for _ in range(fields)], 0
    for b in (x.slice(i, 500) for x in source for i in range(0, x.num_rows, 500)):
        for key, size, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            more = sum(map(len, row))
            if keys and (len(keys) == PART_ROWS or chars + more > PART_CHARS):
                yield keys, sizes, texts
                keys, sizes, texts, chars = [], [], [[] for _ in range(fields)], 0
            keys.append(key)
            sizes.append(size)
            for t, x in zip(texts, row, strict=True):
                t.append(x)
            chars += more
    if keys:
        yield keys, sizes, texts


def posting_rows(df: DataFrame, columns: tuple[str, ...], key: str, analyzer: Grams | Runs) -> DataFrame:
    """term, field, part, docs, keys, sizes, counts, gaps, shard: the rows of the index, see the module's head."""
    lows = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)]
    size = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in columns), F.lit(0)).alias("size")
    kind = df.schema[key].dataType.simpleString()
    ints = "array<int>"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, task = 0, TaskContext.get().partitionId() << 32
        for keys, sizes, texts in _parts(source, len(columns)):
            own, lengths, part = pa.array(keys), pa.array(sizes, pa.int32()), task + nth
            nth += 1

            def row(terms: list, field_: int, bounds: np.ndarray, docs: np.ndarray, counts: np.ndarray, places: np.ndarray, gaps: np.ndarray, own=own, lengths=lengths, part=part) -> pa.RecordBatch:
                lists = lambda v: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), v)
                n, at = len(terms), pa.array(docs)
                return pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array(np.full(n, field_, np.int32)), pa.array(np.full(n, part)), lists(pa.array(docs.astype(np.int32))), lists(own.take(at)), lists(lengths.take(at)),
                     lists(pa.array(counts.astype(np.int32))), pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(gaps.astype(np.int32)))],
                    names=["term", "field", "part", "docs", "keys", "sizes", "counts", "gaps"],
                )

            n = len(keys)
            yield row([""], DOCS, np.array([0, n]), np.arange(n), np.zeros(n, int), np.array([0, 0]), np.empty(0, int))
            for f, t in enumerate(texts):
                number, doc, place, terms = analyzer.places(t)
                by = np.argsort(number, kind="stable")
                number, doc, place = number[by], doc[by], place[by]
                if not len(number):
                    continue
                new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])])  # a document of a term
                first = np.flatnonzero(np.r_[True, number[new][1:] != number[new][:-1]])  # a term
                gaps = np.diff(place, prepend=0)
                gaps[new] = place[new]
                counts = np.diff(np.r_[new, len(number)])
                yield row([terms[i] for i in number[new[first]].tolist()], f, np.r_[first, len(new)], doc[new], counts, np.r_[new[first], len(number)], gaps)

    rows = df.select(key, size, *lows).mapInArrow(run, f"term string, field int, part long, docs {ints}, keys array<{kind}>, sizes {ints}, counts {ints}, gaps {ints}")
    return rows.withColumn("shard", F.when(F.col("field") == DOCS, DOCS).otherwise((F.crc32("term") % SHARDS).cast("int")))


@dataclass(frozen=True)
class Index:
    """A written index: postings and generations of changes below `path`."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    key: str = "id"
    analyzer: Grams | Runs = field(default_factory=Grams)

    def write(self, df: DataFrame, folder: str) -> None:
        """The postings of df in `folder`, whatever was there before."""
        tasks = self.spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < tasks:  # a small table in one file: one task would read it all
            df = df.select(self.key, *self.columns).repartition(tasks)
        rows = posting_rows(df, self.columns, self.key, self.analyzer)
        pages = rows.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS)
        pages = pages.option("parquet.block.size", 8 << 20)
        open_files = "spark.sql.maxConcurrentOutputFileWriters"  # enough of them, and Spark doesn't sort rows by folder
        before = self.spark.conf.get(open_files)
        self.spark.conf.set(open_files, str(max(int(before), SHARDS + 1)))
        try:
            pages.parquet(folder)
        finally:
            self.spark.conf.set(open_files, before)

    def build(self, df: DataFrame) -> Index:
        """All of df as the first generation, with its size; a rebuild replaces it. Null texts are empty, null keys are kept."""
        self.write(df, f"{self.path}/postings/generation=0")
        total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")
        docs = self.rows().where("generation = 0").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("n"), total)
        docs.write.mode("overwrite").parquet(f"{self.path}/size")
        return self

    @property
    def changed(self) -> bool:
        return exists(self.spark, f"{self.path}/gone")

    def rows(self, wanted: list[str] | None = None) -> DataFrame:
        """The rows of the wanted terms; of the documents without terms."""
        df = self.spark.read.parquet(f"{self.path}/postings")
        if wanted is None:
            return df.where(F.col("shard") == DOCS)
        return df.where(F.col("shard").isin(*sorted({shard_of(t) for t in wanted})) & F.col("term").isin(*wanted))

    def current(self, found: DataFrame) -> DataFrame:
        """Of found (key, generation, ...) the rows that no later generation has deleted or replaced."""
        if not self.changed:
            return found
        gone = self.spark.read.parquet(f"{self.path}/gone").groupBy(F.col(self.key)).agg(F.max("generation").alias("_last"))
        return found.join(gone, self.key, "left").where(F.col("_last").isNull() | (F.col("generation") >= F.col("_last"))).drop("_last")

    def documents(self) -> DataFrame:
        """key, size of the documents that the index holds now."""
        return self.current(self.rows().select("generation", F.explode(F.arrays_zip("keys", "sizes")).alias("x")).select("generation", F.col("x.keys").alias(self.key), F.col("x.sizes").alias("size")))

    def size(self) -> tuple[int, float]:
        """(documents, mean size): as written by build(); after changes from the rows that list documents."""
        rows = self.documents().agg(F.count("*"), F.sum("size")) if self.changed else self.spark.read.parquet(f"{self.path}/size")
        n, total = rows.first()
        return n or 0, (total or 0) / (n or 1)

    def apply_changes(self, changed: DataFrame, generation: int) -> None:
        """A batch of changes (key, gone boolean, columns) as one generation: the keys' older postings stop to count,
        those that are still there get new ones. The same generation written again leaves the same index."""
        changed.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.path}/gone/generation={generation}")
        self.write(changed.where(~F.col("gone")), f"{self.path}/postings/generation={generation}")

    def follow(self, changes: DataFrame, order: str, checkpoint: str) -> DataStreamWriter:
        """A writer that applies a stream of changes (see apply_changes), a micro-batch as a generation.

        Of several changes of a key in one micro-batch the last by `order` counts. A batch that is run again after a
        failure writes its own generation again, so the index is the same as without the failure.
        """

        def write(batch: DataFrame, number: int) -> None:
            last = batch.groupBy(self.key).agg(F.max_by(F.struct("gone", *self.columns), order).alias("x"))
            self.apply_changes(last.select(self.key, "x.*"), number + 1)

        return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

    def matches(self, phrases: list[str]) -> DataFrame:
        """key, size, tf array<array<int>> (by phrase, then field): documents with any of the phrases, and how often each
        field holds each (without overlaps). A phrase too short for the index is refused."""
        covers = [self.analyzer.cover(p) for p in phrases]
        short = [p for p, c in zip(phrases, covers, strict=True) if not c]
        if short:
            raise ValueError(f"too short for the index: {short}")
        wanted = sorted({t for c in covers for t, _ in c})
        lengths, fields = [len(p) for p in phrases], len(self.columns)
        rows = self.rows(wanted)
        kind = rows.schema["keys"].dataType.elementType.simpleString()

        def run(key: tuple, part: pa.Table) -> pa.Table:
            lists = {(t, f): i for i, (t, f) in enumerate(zip(part.column("term").to_pylist(), part.column("field").to_pylist(), strict=True))}
            held = lambda name, i: part.column(name)[i].values

            def where(term: str, f: int, offset: int) -> np.ndarray:
                """document * 2^32 + place of the phrase that holds the term at this offset; earlier than the text: none."""
                i = lists.get((term, f))
                if i is None:
                    return np.empty(0, np.int64)
                docs, counts, gaps = (np.asarray(held(c, i)).astype(np.int64) for c in ("docs", "counts", "gaps"))
                ends = np.cumsum(gaps)
                first = np.cumsum(counts) - counts
                place = ends - np.repeat(np.where(first > 0, ends[first - 1], 0), counts) - offset
                return ((np.repeat(docs, counts) << 32) + place)[place >= 0]

            tf: dict[int, np.ndarray] = {}
            for p, cover in enumerate(covers):
                for f in range(fields):
                    by_size = sorted(cover, key=lambda c, f=f: len(held("counts", lists[c[0], f])) if (c[0], f) in lists else 0)
                    found = where(by_size[0][0], f, by_size[0][1])
                    for t, o in by_size[1:]:
                        if not len(found):
                            break
                        found = np.intersect1d(found, where(t, f, o), assume_unique=True)
                    last = -1
                    close = len(found) > 1 and np.diff(found).min() < lengths[p]
                    if close:  # overlaps: the leftmost count
                        kept = []
                        for x in found.tolist():
                            if x >= last:
                                kept.append(x)
                                last = x + lengths[p]
                        found = np.array(kept)
                    for d, n in zip(*(v.tolist() for v in np.unique(found >> 32, return_counts=True)), strict=True):
                        tf.setdefault(d, np.zeros((len(covers), fields), np.int32))[p, f] = n
            docs = np.array(sorted(tf), np.int64)
            every, at = np.unique(np.concatenate([np.asarray(held("docs", i)) for i in range(part.num_rows)]), return_index=True)
            at = pa.array(at[np.searchsorted(every, docs)])
            names, sizes = (pa.concat_arrays([held(c, i) for i in range(part.num_rows)]).take(at) for c in ("keys", "sizes"))
            gen = part.column("generation")[0].as_py()
            return pa.Table.from_arrays(
                [names, sizes, pa.array([tf[d].tolist() for d in docs.tolist()], pa.list_(pa.list_(pa.int32()))), pa.array([gen] * len(docs), pa.int32())],
                names=[self_key, "size", "tf", "generation"],
            )

        self_key = self.key
        out = rows.groupBy("generation", "part").applyInArrow(run, f"`{self.key}` {kind}, size int, tf array<array<int>>, generation int")
        return self.current(out).drop("generation")

    def scored(self, phrases: list[str], weights: list[float]) -> DataFrame:
        """key, score (BM25 summed over the phrases), best (of one phrase), hit_terms int, field int (the first that holds any).

        Document frequencies are one aggregate row of the matches, which are worked out once; no shuffle after them.
        """
        found = once(self.matches(phrases))
        n, mean = self.size()
        hit = lambda p: F.exists(F.col("tf")[p], lambda x: x > 0)
        freq = found.agg(*[F.count_if(hit(p)).alias(f"d{p}") for p in range(len(phrases))]).first()
        norm = K1 * (1 - B + B * F.col("size") / (mean or 1.0))
        parts = []
        for p in range(len(phrases)):
            w = sum((F.col("tf")[p][f] * weight for f, weight in enumerate(weights)), F.lit(0.0))
            parts.append(F.log(F.lit(1 + (n - freq[p] + 0.5) / (freq[p] + 0.5))) * w * (K1 + 1) / (w + norm))
        hits = sum((hit(p).cast("int") for p in range(len(phrases))), F.lit(0))
        in_field = [F.array_max(F.transform("tf", _at(f))) > 0 for f in range(len(weights))]
        first = F.array_position(F.array(*in_field), True) - 1
        best = F.greatest(*parts) if len(parts) > 1 else parts[0]
        return found.select(self.key, sum(parts, F.lit(0.0)).alias("score"), best.alias("best"), hits.alias("hit_terms"), first.cast("int").alias("field"))

    def top(self, phrases: list[str], weights: list[float], k: int = 50) -> DataFrame:
        """key, score, hit_terms of the k best by score, ties by key."""
        return self.scored(phrases, weights).select(self.key, "score", "hit_terms").orderBy(F.desc("score"), self.key).limit(k)


def rarest(index: Index, titles: DataFrame, field_: int, n: int) -> DataFrame:
    """title_id, title, term, f: of every title of n characters or more, the gram that fewest documents hold in a field
    (ties: the first in order), with that number. A title with a gram that no document holds gives no row."""
    low = F.lower("title")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))
    each = titles.where(F.length("title") >= n).select("title_id", "title", F.explode(grams).alias("term"))
    lists = index.spark.read.parquet(f"{index.path}/postings").where((F.col("field") == field_) & (F.col("shard") != DOCS))
    freq = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("f"))
    held = each.join(freq, "term", "left").groupBy("title_id", "title").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "term")).alias("x"))
    return held.where("x.f > 0").select("title_id", "title", "x.term", "x.f")


def containing(index: Index, df: DataFrame, titles: DataFrame, column: str = "content") -> DataFrame:
    """source (key of a document), target (title_id): documents whose text holds a title (title_id, title) as it is
    written, of as many characters as the index's grams or more.

    A title's rarest gram gives its candidates from one list; the texts of candidates alone are looked at, each once for
    all its titles. The index is one of Grams that holds `column`.
    """
    at, n = index.columns.index(column), index.analyzer.n
    anchors = rarest(index, titles, at, n).select("term", "title_id")
    lists = index.spark.read.parquet(f"{index.path}/postings").where((F.col("field") == at) & (F.col("shard") != DOCS))
    near = index.current(lists.join(anchors, "term").select("generation", "title_id", F.explode("keys").alias(index.key)))
    asked = near.groupBy(index.key).agg(F.collect_set("title_id").alias("ts"))
    size = titles.agg(F.sum(F.octet_length("title") + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # titles meet the texts where these are, so that none goes through a shuffle for a candidate
        each = df.select(index.key, column).join(asked, index.key).select(F.col(index.key).alias("source"), column, F.explode("ts").alias("title_id"))
        hits = each.join(F.broadcast(titles.select("title_id", "title").distinct()), "title_id").where(F.col(column).contains(F.col("title")))
        return hits.select("source", F.col("title_id").alias("target"))
    named = near.distinct().join(titles.select("title_id", "title"), "title_id").groupBy(index.key).agg(F.collect_set(F.struct("title_id", "title")).alias("ts"))
    hits = df.select(index.key, column).join(named, index.key).select(F.col(index.key).alias("source"), F.explode(F.filter("ts", lambda t: F.col(column).contains(t["title"]))).alias("t"))
    return hits.select("source", F.col("t.title_id").alias("target"))


def _at(i: int):
    return lambda x: x[i]


def page(scored: DataFrame, df: DataFrame, limit: int = 20, offset: int = 0, key: str = "id", newest: str = "updated_minute", columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """A page of scored rows that df (the scope) holds: most terms, first field, best BM25, newest, smallest key.

    Only the keys and `newest` of df are joined to all matches; `columns` are joined to the page alone.
    """
    there = scored.join(df.select(key, newest), key)
    order = [F.desc("hit_terms"), F.asc("field"), F.desc("best"), F.desc_nulls_last(newest), F.asc(key)]
    rows = there.orderBy(*order).offset(offset).limit(limit)
    nth = F.row_number().over(Window.orderBy(*order))  # over the page
    return rows.withColumn("nth", nth).join(df.select(key, *columns), key).select(key, "nth", "hit_terms", "field", "best", *columns)


def recall(index: Index, df: DataFrame, phrases: list[str]) -> DataFrame:
    """phrase, truth, found, missing, extra, recall: the index against a scan of the texts, phrase by phrase.

    One scan of df finds all phrases; hits meet by key, so both sides of the difference are counted.
    """
    text = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in index.columns]
    holds = lambda p: F.exists(F.array(*text), lambda t: t.contains(p.lower()))
    truth = df.select(index.key, F.explode(F.array_compact(F.array(*[F.when(holds(p), F.lit(i)) for i, p in enumerate(phrases)]))).alias("p"), F.lit(1).alias("a"))
    hit = lambda i: F.when(F.exists(F.col("tf")[i], lambda x: x > 0), F.lit(i))
    found = index.matches(phrases).select(index.key, F.explode(F.array_compact(F.array(*[hit(i) for i in range(len(phrases))]))).alias("p"), F.lit(1).alias("b"))
    both = truth.join(found, [index.key, "p"], "full").groupBy("p").agg(F.count("a").alias("truth"), F.count("b").alias("found"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_both"))
    names = df.sparkSession.createDataFrame(list(enumerate(phrases)), "p int, phrase string")
    rows = F.broadcast(names).join(both, "p", "left").na.fill(0)
    return rows.select("phrase", "truth", "found", "missing", "extra", F.when(F.col("truth") == 0, 1.0).otherwise(F.col("_both") / F.col("truth")).alias("recall"))


def phrase_of(c: Column) -> Column:
    """A column's text as phrases are compared: lower case, null as empty."""
    return F.lower(F.coalesce(c, F.lit("")))
