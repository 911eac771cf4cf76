"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a step. Shards take turns;
at its turn a shard claims the first slot of its permutation that is still free, until no slot is free. A key goes to
the shard that holds slot hash(key) mod size. Removing a shard moves few keys besides its own.

The table has `table_size` rows whatever the data, so broadcasting it is bounded by that parameter, and placement is
one hash and one broadcast-hash probe per row: no shuffle, and a hot source cannot load one shard because the key is
hashed. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, TABLE_SIZE = 16, 2039


def _hash(text: Column) -> Column:
    """48 bits of MD5 as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """slot int, shard int (its place in `shards`), shard_name. One row per slot.

    The fill is one fold over the turns: the state is the array of slots claimed so far, turn k belongs to shard
    k mod n, and it claims the first element of that shard's permutation outside the state.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not _is_prime(table_size) or table_size < len(shards):
        raise ValueError("table_size must be a prime not below the number of shards")
    n = len(shards)
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in shards])).alias("shard", "shard_name"))
    offset = _hash(F.concat("shard_name", F.lit(":offset"))) % table_size
    step = _hash(F.concat("shard_name", F.lit(":step"))) % max(1, table_size - 1) + 1
    turns = F.sequence(F.lit(0), F.lit(table_size - 1))
    preference = F.transform(turns, lambda j: ((F.col("offset") + j * F.col("step")) % table_size).cast("int"))
    orders = names.withColumns({"offset": offset, "step": step}).select("shard", preference.alias("preference"))
    one = orders.agg(F.sort_array(F.collect_list(F.struct("shard", "preference"))).alias("orders"))
    claimed = F.aggregate(
        turns,
        F.array().cast("array<int>"),
        lambda taken, k: F.concat(
            taken, F.slice(F.array_except(F.col("orders")[k % n]["preference"], taken), 1, 1)
        ),
    )
    slots = one.select(F.posexplode(claimed).alias("turn", "slot"))
    named = F.array(*[F.lit(s) for s in shards])
    return slots.select("slot", (F.col("turn") % n).alias("shard"), named[F.col("turn") % n].alias("shard_name"))


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[str] | None = None, table_size: int = TABLE_SIZE
) -> DataFrame:
    """df's columns plus slot int, shard int and shard_name string, one output row per input row.

    Null keys are placed by the hash of the empty text, so they share one slot; repeated keys share a slot; an empty
    df gives no rows. Columns of df with the names of the three new ones are replaced.
    """
    shards = shards or [f"shard-{i}" for i in range(SHARDS)]
    own = [c for c in df.columns if c not in ("slot", "shard", "shard_name")]
    placed = df.select(*own, (_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))) % table_size).cast("int").alias("slot"))
    slots = lookup_table(df.sparkSession, shards, table_size)
    return placed.join(F.broadcast(slots), "slot").select(*own, "slot", "shard", "shard_name")


ORACLE = f"""
WITH RECURSIVE names AS (
  SELECT i, 'shard-' || i AS name FROM range({SHARDS}) t(i)
), prefs AS (
  SELECT list(p ORDER BY i) AS prefs FROM (
    SELECT i, list_transform(range({TABLE_SIZE}), lambda j:
        (CAST('0x' || substr(md5(name || ':offset'), 1, 12) AS BIGINT) % {TABLE_SIZE}
         + j * (CAST('0x' || substr(md5(name || ':step'), 1, 12) AS BIGINT) % {TABLE_SIZE - 1} + 1)) % {TABLE_SIZE}) AS p
    FROM names)
), fill AS (
  SELECT CAST(0 AS BIGINT) AS k, list_transform(range({TABLE_SIZE}), lambda s: CAST(-1 AS BIGINT)) AS owner
  UNION ALL
  SELECT k + 1, list_transform(range({TABLE_SIZE}), lambda s: CASE WHEN s = slot THEN k % {SHARDS} ELSE owner[s + 1] END)
  FROM (SELECT k, owner, list_filter(prefs[k % {SHARDS} + 1], lambda p: owner[p + 1] = -1)[1] AS slot
        FROM fill, prefs WHERE k < {TABLE_SIZE})
), done AS (SELECT owner FROM fill WHERE k = {TABLE_SIZE}),
placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard, 'shard-' || owner[slot + 1] AS shard_name FROM placed, done
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
