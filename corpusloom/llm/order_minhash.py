"""Order MinHash fingerprints: sketches of a text that change with the order of its parts, not with its set alone.

A text's tokens are its words; a character of a script written without blanks is a token of its own. Its k-mers are K
tokens in a row (a shorter text: the whole), numbered by occurrence, so that the third copy of a k-mer differs from the
first. A hash of k-mer and number deals each to one of 64 bins and ranks it there (one permutation serves all bins). In
each bin the TAKE smallest are selected, put back in the order of the text, and hashed as a tuple. The fingerprint is
the list of bins with their tuples; bins without k-mers are left out. Two fingerprints are as alike as the share of the
bins used by either whose tuples are equal: unlike sets and moved passages both lower it, as edit distance does.

DataFrame functions only. Everything that a text needs is inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let, placed, table

K, TAKE = 3, 2
#: 2 to this power documents in a row share a task.
BLOCK_BITS = 6
#: Kana and ideographs: scripts without blanks between words.
UNSPACED = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
#: Places' factors in a k-mer's number: below 2^29, so that sums of factors times CRC-32 stay below 2^63.
FACTORS = (387_420_489, 244_140_625, 282_475_249)
#: Modulus of the ranks, and how far an occurrence number moves a k-mer on.
PRIME, NTH = (1 << 31) - 1, 1_500_450_271
#: A rank stands in the upper bits of a long, the place in the lower 32; 64 bins are the rank's first six bits, the rest are 25.
PLACE, BIN_SHIFT, REST = 1 << 32, 57, 25


def tokens(text: Column) -> Column:
    """array<string>: words between blanks; in texts of unspaced scripts, their characters too."""
    t = F.coalesce(text, F.lit(""))
    spaced = t
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.when(t.rlike(f"[{UNSPACED}]"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).otherwise(F.array_remove(F.split(spaced, " "), ""))


def kmers(text: Column) -> Column:
    """array<bigint>: a number below PRIME for each K tokens in a row, with repeats, in the upper bits, its place in the
    lower 32; a text of fewer tokens is one k-mer, of none has none. The number is the sum of the tokens' CRC-32, each
    with the factor of its place, modulo PRIME; k-mers of equal numbers count as equal."""
    whole = lambda c, i: sum((c[i + j] * f for j, f in enumerate(FACTORS[1:], 1)), c[i] * FACTORS[0]) % PRIME
    short = lambda c: F.array(sum((F.coalesce(F.get(c, F.lit(j)), F.lit(0)) * f for j, f in enumerate(FACTORS[1:], 1)), c[0] * FACTORS[0]) % PRIME * PLACE)
    rows = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - K), lambda i: whole(c, i) * PLACE + i)
    codes = F.transform(tokens(text), lambda w: F.crc32(w))
    return let(codes, lambda c: F.when(F.size(c) >= K, rows(c)).when(F.size(c) == 0, F.array().cast("array<bigint>")).otherwise(short(c)))


def number(v: Column) -> Column:
    return F.shiftright(v, 32)


def places_where(s: Column, test) -> Column:
    """The places j, from 0, of a non-empty array for which test(j) is true."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), test)


def ranked(grams: Column) -> Column:
    """array<bigint>, ascending: rank of each k-mer with its occurrence number, and in the lower 32 bits its place.

    The first of equal k-mers ranks by its number, the nth after it by the number moved on n times by NTH.
    """

    def counted(s: Column) -> Column:
        again = lambda v, j: number(v) == number(F.get(s, j - 1))
        first = F.filter(s, lambda v, j: ~F.coalesce(again(v, j), F.lit(False)))

        def moved(d: Column) -> Column:
            """d: places in s of k-mers that came before; places in a row are one k-mer's."""
            heads = places_where(d, lambda r: F.coalesce(d[r] != F.get(d, r - 1) + 1, F.lit(True)))
            move = lambda v, n: (number(v) + n * NTH) % PRIME * PLACE + v.bitwiseAND(PLACE - 1)
            run = lambda h, a, r: F.transform(F.slice(d, a + 1, F.coalesce(F.get(h, r + 1), F.size(d)) - a), lambda j, n: move(s[j], n.cast("long") + 1))
            return let(heads, lambda h: F.flatten(F.transform(h, lambda a, r: run(h, a, r))))

        more = let(places_where(s, lambda j: again(s[j], j)), lambda d: F.when(F.size(d) > 0, moved(d)).otherwise(F.array().cast("array<bigint>")))
        return F.sort_array(F.concat(first, more))

    return let(F.sort_array(grams), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(s))


def entries(text: Column, take: int = TAKE) -> Column:
    """array<string>, one entry for each bin that holds k-mers, in order: bin (2 digits) and tuple hash (8 hex digits)."""
    bin_of = lambda v: F.shiftright(v, BIN_SHIFT)
    same = lambda s, v, j: F.coalesce(bin_of(F.get(s, j)) == bin_of(v), F.lit(False))
    smallest = lambda t: F.filter(t, lambda v, j: ~same(t, v, j - take))
    # bin, place (32 bits), rest of the rank (25 bits)
    by_place = lambda v: F.shiftleft(bin_of(v), BIN_SHIFT) + F.shiftleft(v.bitwiseAND(PLACE - 1), REST) + number(v).bitwiseAND((1 << REST) - 1)
    in_text = F.sort_array(F.transform(let(ranked(kmers(text)), smallest), by_place))

    def entry(s: Column, v: Column, j: Column) -> Column:
        """Of the first of a bin: null for others."""
        own = [F.when(same(s, v, j + n), F.get(s, j + n).bitwiseAND((1 << REST) - 1).cast("string")) for n in range(take)]
        whole = F.concat(F.substring((bin_of(v) + 100).cast("string"), 2, 2), F.substring(F.md5(F.concat_ws(",", *own)), 1, 8))
        return F.when(~same(s, v, j - 1), whole)

    return let(in_text, lambda s: F.array_compact(F.transform(s, lambda v, j: entry(s, v, j))))


def fingerprint(text: Column, take: int = TAKE) -> Column:
    """The entries as one string; null counts as the empty text, whose fingerprint is empty."""
    return F.array_join(entries(text, take), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins used by either list of entries whose tuples are equal; 1 for two empty lists."""
    bins = lambda x: F.transform(x, lambda e: F.substring(e, 1, 2))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / used).cast("double")


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df plus fingerprint string; a column of that name is replaced. One output row per row, no shuffle.

    Null and empty texts, and texts of blanks alone, have the empty fingerprint; long texts are taken whole.
    """
    return df.withColumn(name, fingerprint(F.col(text)))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, entries, next_text, next_entries: each row with the next one in descending order of key.

    After the last comes the first. Null keys come last, equal keys by a hash of their texts. Rows are dealt by ranges of
    that order, which puts a key with any share of the rows into many tasks, and once more by blocks of 2^BLOCK_BITS rows, each
    with the first row of the block after it. Null texts count as empty. One output row per row; other columns go.
    """
    scratch = Scratch(df.sparkSession, "fingerprints")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    at = placed(scratch, rows, [F.col("key").desc_nulls_last(), F.col("tie"), F.col("nth")]).drop("tie", "nth")
    at = at.withColumn("entries", entries(F.col("text")))
    block = lambda n: F.shiftright(n, BLOCK_BITS)
    place, total = F.col("place"), F.col("total")
    again = F.when(place == 0, total).otherwise(place)  # the first row also follows the last
    member = lambda b, n, own: F.struct(b.alias("block"), n.alias("n"), F.lit(own).alias("own"))
    own, guest = member(block(place), place, True), member(block(again - 1), again, False)
    dealt = at.select("key", "text", "entries", F.explode(F.when(place == F.shiftleft(block(place), BLOCK_BITS), F.array(own, guest)).otherwise(F.array(own))).alias("in"))
    by = Window.partitionBy("in.block").orderBy("in.n")
    follows = lambda c: F.lead(c).over(by).alias(f"next_{c}")
    return dealt.select("key", "text", "entries", "in", follows("text"), follows("entries")).where("in.own").drop("in").withColumnRenamed("key", key)


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_entries", entries(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array_join("entries", "").alias("fingerprint"), F.array_join("edited_entries", "").alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER w AS pos,
   coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM d),
v AS (SELECT pos, 0 AS k, t FROM e UNION ALL SELECT pos, 1, edited FROM e UNION ALL SELECT pos, 2, next FROM e),
w AS (SELECT pos, k, regexp_extract_all(t, '{TOKEN}') AS w FROM v),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
every AS (SELECT DISTINCT unnest(w) AS w FROM w),
code AS (SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS c FROM every, bits),
p AS (SELECT pos, k, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
c0 AS (SELECT pos, k, i, n, c FROM p JOIN code USING (w)),
g AS (SELECT pos, k, i, n, (c * {FACTORS[0]} + coalesce(lead(c) OVER q, 0) * {FACTORS[1]} + coalesce(lead(c, 2) OVER q, 0) * {FACTORS[2]}) % {PRIME} AS g FROM c0 WINDOW q AS (PARTITION BY pos, k ORDER BY i)),
b AS (SELECT *, h >> 25 AS b FROM (SELECT pos, k, i, (g + (row_number() OVER (PARTITION BY pos, k, g ORDER BY i) - 1) * {NTH}) % {PRIME} AS h FROM g WHERE i = 1 OR i <= n - {K - 1})),
c AS (SELECT pos, k, b, lpad(CAST(b AS VARCHAR), 2, '0') || substr(md5(string_agg(h % {1 << REST}, ',' ORDER BY i)), 1, 8) AS e FROM (SELECT *, row_number() OVER (PARTITION BY pos, k, b ORDER BY h, i) AS r FROM b) WHERE r <= {TAKE} GROUP BY pos, k, b),
f AS (SELECT pos, k, list(e ORDER BY e) AS f FROM c GROUP BY pos, k),
y AS (SELECT e.*, coalesce(f0.f, []) AS f0, coalesce(f1.f, []) AS f1, coalesce(f2.f, []) AS f2 FROM e LEFT JOIN f f0 ON f0.pos = e.pos AND f0.k = 0 LEFT JOIN f f1 ON f1.pos = e.pos AND f1.k = 1 LEFT JOIN f f2 ON f2.pos = e.pos AND f2.k = 2),
u AS (SELECT *, len(list_distinct(list_transform(f0 || f1, lambda s: s[:2]))) AS u1, len(list_distinct(list_transform(f0 || f2, lambda s: s[:2]))) AS u2 FROM y)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f0, '') AS fingerprint, array_to_string(f1, '') AS edited_fingerprint,
  CASE WHEN u1 = 0 THEN 1.0 ELSE len(list_intersect(f0, f1)) / u1 END AS near_edited, CASE WHEN u2 = 0 THEN 1.0 ELSE len(list_intersect(f0, f2)) / u2 END AS near_next FROM u
"""
