"""N-gram Jaccard join by T-occurrence search over inverted lists, after DivideSkip.

Two documents with sets of a and b shingles link when they meet in T = ceil(share * (a + b) / (1 + share)) inverted
lists. DivideSkip leaves the longest lists out of the merge, as many as T allows, and asks those by binary probes. Here:

1. One pass gives every document its set size and the digest of its set; equal sets are one node from then on. The
   same pass fills a sketch of list lengths (two bits for each of a fixed number of hash bins). The sketch only sets
   the order of lists, short before long, and tells lists that surely hold one node; results don't depend on it.
2. A node posts its id to its short lists: the rarest n - ceil(share * n) + 1 shingles. Two nodes that link meet in one
   of them, as T - 1 long lists at most are left out. Lists of one node are left out.
3. Neighbours by size in a list, and the first, second, ... TURNS-th hub of a list (the nodes with the most lists) with
   all its nodes, are candidates. They are checked by binary probes of one node's shingles, long lists last, in the
   other's sorted set, and given up when what is left can't reach T. Linked nodes form components. This finds whole
   groups of copies with no more candidates than rows of lists, and a group is never expanded into its pairs.
4. Lists whose nodes are in one component have nothing more to say. Of the others, lists of at most SMALL nodes give
   their pairs between components that meet the size and position bounds, checked as above. Longer ones are searched:
   all nodes but those of the list's largest component are queries against all its nodes, in blocks of BLOCK queries and
   BLOCK nodes. A block is one task's work: it inverts its nodes' sets, merges a query's short lists by their counts,
   probes the long ones for candidates that can still reach T, and gives links alone. So no link is lost.

State: the sketch has at most 2 ** 27 bins of two bits (32 MB a task, 16 MB broadcast) whatever the data. Shingles are 64-bit hashes, which two
documents of a million shingles each confuse once in 10 ** 7 pairs; digests of sets are 126 bits, of which 63 name the
node, and sets whose 63 bits agree while the others don't are named by the others.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, lean, small_batches, table
from .tokens import batches, compact

WORDS, SHARE = 5, Fraction(3, 4)
RANGES, MOST_BINS, LIST_PART, BROADCAST_IDS, TURNS, SMALL, BLOCK = 64, 1 << 27, 50_000, 1_000_000, 1, 32, 512
BATCH = 2 << 20
#: Sets named by the second half of their digest; about n * n / 2 ** 64 of n, far below this bound.
MOST_CLASHES = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; a text without words, or null, has none.
    """
    texts = pc.ascii_lower(compact(texts))
    lists = pc.ascii_split_whitespace(texts)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends = ends - ends[0]
    distinct = coded.dictionary.cast(pa.string())
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_py() if len(distinct) else ""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in joined.split(" ")][: len(distinct)], np.uint64)
    full = np.array([bool(w) for w in joined.split(" ")][: len(distinct)], bool)
    codes = np.asarray(coded.indices, dtype=np.int64)
    kept = full[codes] if len(codes) else np.zeros(0, bool)
    before = np.append(0, np.cumsum(kept))
    ends, word = before[ends], hashes[codes[kept]] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        gram = np.zeros(len(word), np.uint64)
        for j in range(words):
            whole = max(0, len(word) - j)
            gram[:whole] = (gram[:whole] ^ word[j:]) * MIX
            gram ^= gram >> np.uint64(29)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        else:
            one = hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(one, np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def digest(own: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two independent digests of the set, 63 bits each; null for the empty set."""
    if not len(own):
        return None, None
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little") >> 1, int.from_bytes(d[8:], "little") >> 1


def node_of(own: np.ndarray, clashes: frozenset = frozenset()) -> int | None:
    """The node of a set: its first digest, or the second one where the first stands for several sets."""
    a, b = digest(own)
    return b if a in clashes else a


def bins_for(df: DataFrame, text: str) -> int:
    """A power of two near the number of words, between 2**16 and MOST_BINS."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MOST_BINS, 1 << max(16, math.ceil(math.log2(size / 6 + 1))))


class Sketch:
    """Two bits a bin, as two bit arrays: bins seen once, and seen twice or more."""

    def __init__(self, bins: int):
        self.bins, self.once, self.twice = bins, np.zeros(bins >> 3, np.uint8), np.zeros(bins >> 3, np.uint8)

    def add(self, every: np.ndarray) -> None:
        at = np.sort((every % np.uint64(self.bins)).astype(np.int64))
        again = at[1:][at[1:] == at[:-1]]
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        seen = (self.once[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        self._set(self.twice, np.sort(np.concatenate([again, at[seen]])))
        self._set(self.once, at)

    @staticmethod
    def _set(bits: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            byte, mask = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
            first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            bits[byte[first]] |= np.bitwise_or.reduceat(mask, first)


def describe(df: DataFrame, key: str, text: str, bins: int, words: int = WORDS) -> DataFrame:
    """Rows of documents (key, n, node, other) and, from each task, of the sketch (range, once, twice), one schema for both."""
    of = df.schema[key].dataType
    arrow = pa.int64() if of.simpleString() == "bigint" else None

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = Sketch(bins), arrow
        names = [key, "n", "node", "other", "range", "once", "twice"]
        for b in batches(source, BATCH):
            sets = shingles(b.column(1), words)
            sketch.add(np.concatenate([*sets, np.zeros(0, np.uint64)]))
            kind, m = b.column(0).type, b.num_rows
            both = [digest(x) for x in sets]
            own = [b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
        if kind is not None and sketch.once.any():
            for r in range(RANGES):
                blobs = [pa.array([zlib.compress(part.reshape(RANGES, -1)[r].tobytes(), 1)], pa.binary()) for part in (sketch.once, sketch.twice)]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.array([r], pa.int32()), *blobs], names=names)

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {of.simpleString()}, n long, node long, other long, range int, once binary, twice binary")


def list_classes(described: DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of the bins that hold more than one node, places of long lists, 2 or 3 for long and very long ones).

    Long is rare by its definition, three deviations above the mean, so this is little more than a bit a bin.
    """
    width = bins // RANGES
    schema = "range int, bits binary, long binary, kinds binary"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(r: int, count: np.ndarray) -> pa.RecordBatch:
            mean = float(count.mean())
            long = np.flatnonzero((count > mean + 3 * mean**0.5 + 1) & (count > 1))
            kinds = (2 + (count[long] > 8 * (mean + 4))).astype(np.uint8)
            blobs = [zlib.compress(x.tobytes(), 1) for x in (np.packbits(count > 1, bitorder="little"), (long + r * width).astype(np.int64), kinds)]
            return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["range", "bits", "long", "kinds"])

        now, count = None, np.zeros(width, np.uint32)
        for b in source:
            for r, once, twice in zip(*b.columns, strict=True):
                if now is not None and now != r.as_py():
                    yield done(now, count)
                    count = np.zeros(width, np.uint32)
                now = r.as_py()
                for x in (once, twice):
                    count += np.unpackbits(np.frombuffer(zlib.decompress(x.as_py()), np.uint8), bitorder="little")[:width]
        if now is not None:
            yield done(now, count)

    parts = described.where("range IS NOT NULL").select("range", "once", "twice").repartition(RANGES, "range").sortWithinPartitions("range")
    bits, long, kinds = np.zeros((RANGES, width // 8), np.uint8), [], []
    for r in sorted(parts.mapInArrow(lean(run), schema).collect()):
        bits[r["range"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        long.append(np.frombuffer(zlib.decompress(r["long"]), np.int64))
        kinds.append(np.frombuffer(zlib.decompress(r["kinds"]), np.uint8))
    return bits.ravel(), np.concatenate([np.zeros(0, np.int64), *long]), np.concatenate([np.zeros(0, np.uint8), *kinds])


def in_order(own: np.ndarray, classes: tuple[np.ndarray, np.ndarray, np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, short lists first, and their classes: 0 one node at most, 1 short, 2 long, 3 very long."""
    bits, long, kinds = classes
    at = (own % np.uint64(bins)).astype(np.int64)
    kind = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    if len(long):
        i = np.minimum(np.searchsorted(long, at), len(long) - 1)
        kind = np.where(long[i] == at, kinds[i], kind)
    by = np.argsort(kind, kind="stable")
    return own[by], kind[by]


def postings(df: DataFrame, text: str, classes, bins: int, clashes: frozenset, share: Fraction = SHARE, words: int = WORDS) -> DataFrame:
    """(h, node, n, at): a node's short lists, but for those that hold no other node. Copies give equal rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, BATCH):
            cols: list[list] = [[], [], [], []]
            for own in shingles(b.column(0), words):
                n, node = len(own), node_of(own, clashes)
                if n:
                    own, kind = in_order(own, classes.value, bins)
                    at = np.flatnonzero(kind[: n - math.ceil(share * n) + 1])
                    for c, x in zip(cols, (own[at].view(np.int64), np.full(len(at), node), np.full(len(at), n, np.int32), at.astype(np.int32)), strict=True):
                        c.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, k)]).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["h", "node", "n", "at"])

    return df.select(text).mapInArrow(lean(run), "h long, node long, n int, at int")


def linked(a: np.ndarray, b: np.ndarray, need: int, step: int = 64) -> bool:
    """Whether a (any order) and b (sorted) share `need` shingles; binary probes, given up when out of reach."""
    got = 0
    for i in range(0, len(a), step):
        part = a[i : i + step]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        got += int((b[at] == part).sum())
        if got >= need:
            return True
        if got + len(a) - i - len(part) < need:
            return False
    return False


def verified(pairs: DataFrame, sets: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """The pairs (a, b) of nodes that link; sets has node and its sorted shingles as binary."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                keep.append(linked(x, y, math.ceil(share * (len(x) + len(y)) / (1 + share))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, each: int = 200_000) -> DataFrame:
    """(node, comp): smallest node reachable, for all nodes of edges (a, b). Large star and small star in turns.

    Steps over few edges run in few tasks: about `each` edges a task.
    """
    smaller, larger = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = checkpointed(edges.where("a <> b").select(larger, smaller).distinct())
    parts = max(1, -(-now.count() // each))
    few = lambda df: df.coalesce(parts)
    now, last = few(now), None
    while True:
        ways = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = few(few(ways.join(least, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = few(checkpointed(few(few(small).distinct())))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return few(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after further links (a, b) of nodes: components of the components that they join."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = comp.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return checkpointed(old.union(more.join(comp.select("node"), "node", "left_anti").select("node", "comp")))


def search(sets: list[np.ndarray], asks: list[bool], comps: np.ndarray, share: Fraction = SHARE, skip: float = 0.0085) -> list[tuple[int, int]]:
    """Pairs (query, other) of places in `sets` that link, from different comps; DivideSkip in one block.

    The sets that don't ask are inverted. Of a query's lists the longest ones, T / (skip * log2(longest) + 1) and at most
    T - 1 for the least T that any set can have, are left out of the merge. Sets that occur often enough in the others
    are looked up in the long lists one by one, by binary search, and drop out when they can't reach their own T.
    """
    base = [i for i, a in enumerate(asks) if not a]
    sizes = np.array([len(sets[i]) for i in base], np.int64)
    flat, owner = np.concatenate([*(sets[i] for i in base), np.zeros(0, np.uint64)]), np.repeat(np.arange(len(base)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    values, ends = flat[starts], np.append(starts[1:], len(flat))
    comp_of, out = comps[base], []
    for q in (i for i, a in enumerate(asks) if a):
        own, n = sets[q], len(sets[q])
        fit = (comp_of != comps[q]) & (sizes * share.denominator >= n * share.numerator) & (n * share.denominator >= sizes * share.numerator)
        if not fit.any():
            continue
        need = -(-share.numerator * (n + sizes) // (share.numerator + share.denominator))
        at = np.searchsorted(values, own)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
        at = at[np.argsort(ends[at] - starts[at], kind="stable")]
        least = int(need[fit].min())
        if len(at) < least:
            continue
        longest = int(ends[at[-1]] - starts[at[-1]])
        long = min(least - 1, len(at) - 1, int(least / (skip * math.log2(longest + 1) + 1)))
        short, late = at[: len(at) - long], at[len(at) - long :]
        seen = np.bincount(np.concatenate([owner[starts[i] : ends[i]] for i in short]), minlength=len(base))
        alive = np.flatnonzero(fit & (seen >= need - long))
        count = seen[alive]
        for left, i in enumerate(late):
            rows = owner[starts[i] : ends[i]]
            place = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
            count = count + (rows[place] == alive)
            keep = count + (long - 1 - left) >= need[alive]
            alive, count = alive[keep], count[keep]
            if not len(alive):
                break
        out += [(q, base[i]) for i in alive[count >= need[alive]]]
    return out


def searched(open_lists: DataFrame, sets: DataFrame, share: Fraction = SHARE, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) between components inside long lists (h, node, comp): blocks of queries against blocks of nodes.

    Blocks hold 32 bits of each shingle. Where those agree by chance a pair may be found that doesn't link, and none is
    lost; the pairs, few beyond the links, are verified afterwards.
    """
    by_comp = open_lists.groupBy("h", "comp").agg(F.count("*").alias("c"))
    whole = by_comp.groupBy("h").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top"))
    rows = open_lists.join(whole, "h").select(
        "h", "node", "comp", (F.col("comp") != F.col("top.comp")).alias("few"), F.ceil(F.col("all") / block).alias("parts"),
        F.ceil((F.col("all") - F.col("top.c")) / block).alias("query_parts"), F.xxhash64("node").alias("x"),
    )
    own = lambda n: F.pmod("x", F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    asks = rows.where("few").select("h", own("query_parts").alias("q"), each("parts").alias("p"), F.lit(True).alias("asks"), "node", "comp")
    rows = asks.union(rows.select("h", each("query_parts").alias("q"), own("parts").alias("p"), F.lit(False), "node", "comp"))

    def run(part: pa.Table) -> pa.Table:
        node, comp = part.column("node").to_numpy(), part.column("comp").to_numpy()
        found = search([np.frombuffer(x.as_py(), np.uint32) for x in part.column("brief")], part.column("asks").to_pylist(), comp, share)
        pairs = {(min(node[i], node[j]), max(node[i], node[j])) for i, j in found}
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    def brief(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            cut = [np.frombuffer(x.as_py(), np.uint64).astype(np.uint32).tobytes() for x in b.column("own")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(cut, pa.binary())], names=["node", "brief"])

    asked = sets.join(open_lists.select("node").distinct(), "node", "left_semi").select("node", "own").mapInArrow(lean(brief), "node long, brief binary")
    return rows.join(asked, "node").groupBy("h", "q", "p").applyInArrow(run, "a long, b long").distinct()


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", share: Fraction = SHARE, words: int = WORDS) -> DataFrame:
    """key, n_shingles long, component_id (the smallest key reachable by links), one row per input row.

    Null and empty texts, and texts of white space, have no shingles and link with nothing: component_id is their key.
    Rows of equal text link, very long texts are whole sets. Null keys stay, and do not count for the smallest key. An
    empty df gives no rows. Other columns are ignored, whatever their names.
    """
    df = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    spark, bins = df.sparkSession, bins_for(df, "_t")
    small_batches(spark)
    disk = Scratch(spark, "near-copies")
    described = disk.keep(describe(df, "_k", "_t", bins, words), "described")
    docs = described.where("range IS NULL").select("_k", "n", "node", "other")
    same = docs.where("node IS NOT NULL").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi")
    clashes = frozenset(r["node"] for r in same.select("node").limit(MOST_CLASHES + 1).collect())
    if len(clashes) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} digests stand for several sets")
    docs = docs.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("other")).otherwise(F.col("node")) if clashes else F.col("node")).drop("other")
    classes = spark.sparkContext.broadcast(list_classes(described, bins))  # little over a bit a bin, 16 MB at most bins

    posted = disk.keep(postings(df, "_t", classes, bins, clashes, share, words).distinct(), "postings")
    classes.destroy()
    sizes = posted.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    posts = posted.groupBy("node").agg(F.count("*").alias("posts"))
    lists = disk.keep(posted.join(sizes, "h").join(posts, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / LIST_PART))), "lists")
    disk.drop(posted)

    near = F.col("n") >= F.ceil(F.lit(share.numerator) * F.col("m") / share.denominator)
    by = Window.partitionBy("h", "part").orderBy("n", "node")
    chain = lists.select(F.col("node").alias("b"), F.col("n").alias("m"), F.lag("node").over(by).alias("a"), F.lag("n").over(by).alias("n"))
    heads = lists.where("c > %d" % LIST_PART).groupBy("h", "part").agg(F.min(F.struct("n", "node")).alias("x"))
    top = Window.partitionBy("h").orderBy("x")
    heads = heads.select(F.col("x.node").alias("b"), F.col("x.n").alias("m"), F.lag("x.node").over(top).alias("a"), F.lag("x.n").over(top).alias("n"))
    first = disk.keep(chain.union(heads).where(F.col("a").isNotNull() & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    nodes = lists.select("node").distinct()
    reps = disk.keep(docs.join(nodes, "node").groupBy("node").agg(F.min("_k").alias("_k")).select("_k").distinct(), "reps")
    chosen = df.join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, "_k", "left_semi").union(df.where("_k IS NULL"))

    def own_sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, BATCH):
            own = shingles(b.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x, clashes) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])

    made = chosen.select("_t").mapInArrow(lean(own_sets), "node long, own binary").where("node IS NOT NULL")
    sets = disk.keep(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = disk.keep(verified(first, sets, share), "links")
    comp = checkpointed(components(links))

    need = F.ceil(F.lit(share.numerator) * (F.col("n") + F.col("m")) / (share.numerator + share.denominator))
    reach = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need
    size = F.least("n", "m") * share.denominator >= F.greatest("n", "m") * share.numerator
    apart = (F.col("ca") != F.col("cb")) & size & reach

    def still_open(comp: DataFrame) -> DataFrame:
        """Rows of the lists whose nodes are not all in one component; c counts them."""
        placed = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
        return disk.keep(placed.join(mixed, "h", "left_semi").select("h", "part", "node", "n", "at", "comp", "posts", "c"), "open")

    tried, open_lists = first, still_open(comp)
    for turn in range(TURNS):
        by = Window.partitionBy("h", "part").orderBy(F.desc("posts"), F.xxhash64("node", F.lit(turn)))
        hub = F.nth_value(F.struct("node", "n", "at", "comp"), turn + 1).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ways = open_lists.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("comp").alias("cb"), hub.alias("x"))
        ways = ways.select("*", F.col("x.node").alias("a"), F.col("x.n").alias("n"), F.col("x.at").alias("i"), F.col("x.comp").alias("ca"))
        ways = ways.where(F.col("a").isNotNull() & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ways = disk.keep(ways.join(tried, ["a", "b"], "left_anti"), "ways")
        found = disk.keep(verified(ways, sets, share), "found")
        tried = tried.union(ways)
        if found.count():
            comp = merged(comp, found)
            disk.drop(open_lists)
            open_lists = still_open(comp)

    small = open_lists.where(F.col("c") <= SMALL)
    left = small.select("h", F.col("node").alias("a"), F.col("n"), F.col("at").alias("i"), F.col("comp").alias("ca"))
    right = small.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("comp").alias("cb"))
    rest = left.join(right, "h").where((F.col("a") < F.col("b")) & apart)
    rest = disk.keep(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    pairs = disk.keep(rest.union(searched(open_lists.where(F.col("c") > SMALL), sets, share)).distinct(), "pairs")
    more = disk.keep(verified(pairs, sets, share), "more")
    if more.count():
        comp = merged(comp, more)
    disk.drop(lists, sets, open_lists, rest, first)

    whole = docs.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = whole.where("comp IS NOT NULL").groupBy("comp").agg(F.min("_k").alias("component_id"))
    out = whole.join(least, "comp", "left")
    return out.select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_k").alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
