"""Merkle manifest of a dataset: one tree a group, a tree over the groups' roots, and a proof for each row.

Bottom up: rows become leaf digests in one scan; leaves get their place in their group by a range sort of the narrow
digest table; every FAN consecutive nodes become their parent's digest, level by level, each level written as a table
of runs (parent, its children from left to right). Top down: a level's runs are joined with the proofs that their
parents inherited; each child prepends its own siblings. The tree over groups is made and pushed by the same code.

Texts are read once and never shuffled. A run has at most FAN children, so a group with any share of all rows is many
rows; levels shrink by FAN. The proofs of leaves are digested in the task that makes them and are not written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, placed, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sibling's place in a proof: what stands left and right of the own digest.
PROOF = "array<struct<before: string, after: string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def item(c: Column) -> Column:
    """A value as text that can't be confused with another: - for null, else its UTF-8 bytes' count, a colon, the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[item(v) for v in values]))


def tree_name(group: Column) -> Column:
    """A name that is never null and sorts as the group does, nulls first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def levels(scratch: Scratch, leaves: DataFrame, order: list[Column]) -> list[DataFrame]:
    """Written runs of each level, lowest first: tree, run (place of the parent), n (nodes of the tree at this level),
    kids array<struct<place, digest, own>>, digest (of the parent). leaves: tree string, digest string, own struct.

    Trees of one node at a level are done: their only kid is the root. order starts with the tree.
    """
    nodes = placed(scratch, leaves, order, ("tree",)).withColumnRenamed("total", "n")
    out, most = [], None
    while True:
        kids = F.array_sort(F.collect_list(F.struct("place", "digest", "own"))).alias("kids")
        grouped = nodes.groupBy("tree", F.expr(f"place div {FAN}").alias("run"), "n").agg(kids)
        runs = scratch.keep(grouped.withColumn("digest", digest(F.array_join("kids.digest", ""))), "level")
        out.append(runs)
        most = (runs.agg(F.max("n")).first()[0] or 0) if most is None else -(-most // FAN)
        if most <= 1:
            return out
        above = F.expr(f"(n + {FAN - 1}) div {FAN}")
        nodes = runs.where("n > 1").select("tree", F.col("run").alias("place"), above.alias("n"), "digest", F.lit(None).cast("string").alias("own"))


def roots(runs: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root."""
    return reduce(DataFrame.unionByName, [r.where("n = 1").select("tree", F.col("kids")[0]["digest"].alias("digest")) for r in runs])


def pushed(scratch: Scratch, runs: list[DataFrame], top: DataFrame) -> DataFrame:
    """One row a leaf: tree, digest, own, proof and the further columns of top (tree, proof, ...), which holds what the
    roots inherit. Proofs above the leaves are written level by level."""
    extra = [c for c in top.columns if c != "tree"]
    carried = [c for c in extra if c != "proof"]
    inherited = None
    for k in range(len(runs) - 1, -1, -1):
        kid = F.col("kid")
        done = runs[k].where("n = 1").join(top, "tree").select("tree", F.lit(0).cast("long").alias("place"), F.col("kids")[0].alias("kid"), *extra)
        if inherited is not None:
            digests = F.col("kids.digest")
            side = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice(digests, F.col("i") + 2, F.lit(FAN)), "").alias("after"))
            each = runs[k].where("n > 1").drop("digest").join(inherited.withColumnRenamed("place", "run"), ["tree", "run"])
            each = each.select("tree", "run", "kids", *extra, F.posexplode("kids").alias("i", "kid"))
            many = each.select("tree", kid["place"].alias("place"), "kid", *carried, F.concat(F.array(side), "proof").alias("proof"))
            done = done.unionByName(many)
        inherited = scratch.keep(done.drop("kid"), "pushed") if k else done
    return inherited.select("tree", F.col("kid.digest").alias("digest"), F.col("kid.own").alias("own"), *extra)


def sides(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> DataFrame:
    """The key, leaf, subroot, root, proof (array of siblings by level), altered_leaf: one row per row of df.

    `altered` replaces fields for altered_leaf, which is else the leaf; folded(altered_leaf, proof) = root tells whether
    a row is what the manifest was made of. Rows are ordered by key (nulls first), equal keys by leaf; repeated rows are
    leaves of their own with proofs of their own. Nulls in any field have a mark of their own; a null group is a tree of
    its own, the first. Empty and long texts are digested whole. An empty df gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "merkle")
    values = [F.col(f) for f in fields]
    changed = leaf([(altered or {}).get(f, F.col(f)) for f in fields])
    narrow = df.select(tree_name(F.col(group)).alias("tree"), leaf(values).alias("digest"), F.struct(F.col(key).alias("key"), changed.alias("altered")).alias("own"))
    leaves = scratch.keep(narrow.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    by = [F.col("tree"), F.col("own.key").asc_nulls_first(), F.col("digest"), F.col("nth")]
    runs = levels(scratch, leaves, by)
    tops = scratch.keep(roots(runs).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("own")), "roots")
    above = levels(scratch, tops, [F.col("tree"), F.col("own")])
    found = roots(above).first()
    none = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PROOF).alias("proof"))
    inherited = pushed(scratch, above, none).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "proof")
    out = pushed(scratch, runs, scratch.keep(inherited, "inherited"))
    root = F.lit(found["digest"] if found else None).cast("string").alias("root")
    return out.select(F.col("own.key").alias(key), F.col("digest").alias("leaf"), "subroot", root, "proof", F.col("own.altered").alias("altered_leaf"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    tampered = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    out = manifest(docs, altered={"text": tampered})
    out = out.select("doc_id", "leaf", "subroot", "root", digest(sides(F.col("proof"))).alias("proof_sha256"), folded(F.col("altered_leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_ITEM = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_ITEM.format(c) for c in FIELDS[:-1]) + " || {})"
_UP = f"""SELECT tree, lvl + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(d, '' ORDER BY pos)) FROM {{0}} WHERE n > 1 GROUP BY tree, lvl, pos // {FAN}, n"""
_SIDES = f"""SELECT tree, lvl, pos, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {{0}} WINDOW w AS (PARTITION BY tree, lvl, pos // {FAN} ORDER BY pos)"""
_WALK = f"""SELECT p.doc_id, p.source, p.tree, p.lvl + 1, p.pos // {FAN}, sha256(b || acc || a), proof || b || a FROM {{0}} p JOIN {{1}} s ON s.tree = p.tree AND s.lvl = p.lvl AND s.pos = p.pos WHERE s.n > 1"""
ORACLE = f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
docs AS (SELECT documents.*, coalesce(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
   lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 5 = 0, false) AS hit FROM documents, bits),
lv AS MATERIALIZED (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_LEAF.format(_ITEM.format("text"))} AS leaf,
   {_LEAF.format(_ITEM.format("(CASE WHEN hit THEN translate(text, '" + UPPER + "', '" + LOWER + "') ELSE text END)"))} AS changed FROM docs),
base AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM lv),
up AS (SELECT tree, 0 AS lvl, pos, n, leaf AS d FROM base UNION ALL {_UP.format("up")}),
sub AS MATERIALIZED (SELECT tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT '' AS tree, 0 AS lvl, pos, n, d FROM sub UNION ALL {_UP.format("top")}),
s1 AS MATERIALIZED ({_SIDES.format("up")}), s2 AS MATERIALIZED ({_SIDES.format("top")}),
w1 AS (SELECT doc_id, tree AS source, tree, 0 AS lvl, pos, changed AS acc, '' AS proof FROM base UNION ALL {_WALK.format("w1", "s1")}),
w2 AS (SELECT w1.doc_id, w1.source, '' AS tree, 0 AS lvl, sub.pos, acc, proof FROM w1 JOIN s1 ON s1.tree = w1.tree AND s1.lvl = w1.lvl AND s1.pos = w1.pos AND s1.n = 1 JOIN sub ON sub.source = w1.source
   UNION ALL {_WALK.format("w2", "s2")}),
fin AS (SELECT w2.doc_id, acc, proof FROM w2 JOIN s2 ON s2.lvl = w2.lvl AND s2.pos = w2.pos AND s2.n = 1)
SELECT base.doc_id, leaf, sub.d AS subroot, top.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top.d AS verified
FROM base JOIN fin USING (doc_id) JOIN sub ON sub.source = base.tree JOIN top ON top.n = 1
"""
