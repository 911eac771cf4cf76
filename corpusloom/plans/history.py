"""Queries over operations that go back, versions kept, and an index that follows changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, postings
from ..sources.tables import SHELF_SQL, SQL, documents, shelf, table
from ..sources.workspace import shared_dir
from .base import query

STEP = 6 * 3600


@query("m_version_snapshots", f"""WITH e AS (SELECT user_id, {{'t': epoch_us(ts), 'd': event_type, 'f': value > 90, 'kept': CAST([] AS BIGINT[])}} AS x, sha256('["' || event_type || '"]') AS h FROM events),
o AS (SELECT user_id, list(x ORDER BY x.t, h) AS xs FROM e GROUP BY user_id),
l AS (SELECT user_id, list_reduce(list_concat([{{'t': CAST(0 AS BIGINT), 'd': CAST(NULL AS VARCHAR), 'f': false, 'kept': CAST([] AS BIGINT[])}}], xs),
  lambda a, y: CASE WHEN a.d IS NULL OR (y.d <> a.d AND (y.f OR y.t - a.t >= {STEP * 1_000_000})) THEN {{'t': y.t, 'd': y.d, 'f': y.f, 'kept': list_append(a.kept, y.t)}} ELSE a END).kept AS k FROM o)
SELECT user_id, make_timestamp(unnest(k[-20:])) AS ts FROM l""")
def m_version_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    saves = table(spark, sf, "events").select("user_id", "ts", "event_type", (F.col("value") > 90).alias("forced"))
    return history.versions(saves, "user_id", "ts", ("event_type",), "forced", STEP, 20)


FIELDS = ("title", "language", "cover_path")
KINDS = ("batch_update", "language_normalize", "batch_soft_delete", "directory_import", "cover_upload", "reextract", "orphan_quarantine")


@query("m_undo_by_kind", SHELF_SQL + """, l AS (SELECT id, id % 7 AS k, id % 5 <> 4 AS undoable, id % 19 = 0 AS undone, deleted, id % 10 = 1 AS moved, id % 4 <> 0 AS there, id % 8 = 2 AS taken FROM s),
r AS (SELECT k, undoable, undone, CASE WHEN undone THEN CASE WHEN k < 6 THEN 'already_undone' ELSE 'none' END WHEN NOT undoable OR k = 5 THEN CASE WHEN k < 6 THEN 'not_undoable' ELSE 'none' END
  WHEN k < 2 THEN CASE WHEN moved THEN 'modified_after_operation' END WHEN k = 2 THEN CASE WHEN NOT deleted THEN 'not_deleted' END WHEN k = 3 THEN CASE WHEN deleted THEN 'already_deleted' END
  WHEN k = 6 THEN CASE WHEN NOT there THEN 'gone' WHEN taken THEN 'occupied' END END AS reason FROM l)
SELECT k AS op, reason, count(*) AS n FROM r WHERE reason IS NULL OR reason <> 'none' GROUP BY k, reason""")
def m_undo_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons by operation of a log of seven kinds over all rows; every tenth row changed after it."""
    df = shelf(spark, sf)
    before = F.struct(F.concat(F.lit("old "), "title").alias("title"), "language", F.lit("covers/old").alias("cover_path"))
    kind = F.array(*map(F.lit, KINDS))[(F.col("id") % 7).cast("int")]
    log = df.select(
        (F.col("id") % 7).alias("op"), kind.alias("kind"), "id", F.array(F.lit("title")).alias("fields"), before.alias("before"), F.struct(*FIELDS).alias("after"),
        (F.col("id") % 5 != 4).alias("undoable"), (F.col("id") % 19 == 0).alias("undone"), F.concat(F.lit("at/"), "id").alias("path"), F.concat(F.lit("away/"), "id").alias("stored"),
    )
    title = F.when(F.col("id") % 10 == 1, "changed").otherwise(F.col("title")).alias("title")
    now = df.select("id", title, "language", "cover_path", F.when(F.col("deleted"), F.lit(7)).cast("long").alias("deleted_minute"))
    disk = df.where("id % 4 <> 0").select(F.concat(F.lit("away/"), "id").alias("path")).union(df.where("id % 8 = 2").select(F.concat(F.lit("at/"), "id")))
    _, outcomes = history.undone(now, log, FIELDS, 99, disk=disk)
    return outcomes.groupBy("op", "reason").agg(F.count("*").alias("n"))


@query("m_undo_states", SHELF_SQL + """, l AS (SELECT id, id % 4 AS k, id % 10 = 1 AS moved, deleted, title, cover_path FROM s)
SELECT id, CASE WHEN k = 0 AND NOT moved THEN 'old ' || title WHEN moved THEN 'changed' ELSE title END AS title, CASE WHEN k = 3 THEN 'covers/old' ELSE cover_path END AS cover_path,
  CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN CASE WHEN deleted THEN 7 ELSE 99 END WHEN deleted THEN 7 END AS deleted_minute FROM l""")
def m_undo_states(spark: SparkSession, sf: str) -> DataFrame:
    df = shelf(spark, sf)
    kind = F.array(*[F.lit(KINDS[i]) for i in (0, 2, 3, 4)])[(F.col("id") % 4).cast("int")]
    before = F.struct(F.concat(F.lit("old "), "title").alias("title"), "language", F.lit("covers/old").alias("cover_path"))
    yes, no = F.lit(True).alias("undoable"), F.lit(False).alias("undone")
    log = df.select(F.lit(1).cast("long").alias("op"), kind.alias("kind"), "id", F.array(F.lit("title")).alias("fields"), before.alias("before"), F.struct(*FIELDS).alias("after"), yes, no)
    title = F.when(F.col("id") % 10 == 1, "changed").otherwise(F.col("title")).alias("title")
    now = df.select("id", title, "language", "cover_path", F.when(F.col("deleted"), F.lit(7)).cast("long").alias("deleted_minute"))
    return history.undone(now, log, FIELDS, 99)[0].select("id", "title", "cover_path", "deleted_minute")


@query("l_index_follows", SQL + ", n AS (SELECT id, CASE WHEN id % 4 = 1 THEN 'worthless idiot ' || title ELSE title END AS title, CASE WHEN id % 4 = 1 THEN NULL ELSE content END AS content FROM d WHERE id % 4 <> 2), p(phrase) AS (VALUES ('with'), ('worthless idiot'), ('the')) SELECT phrase, count(id) AS n, sum(id) AS ids FROM p LEFT JOIN n ON contains(lower(title), phrase) OR contains(lower(content), phrase) GROUP BY phrase")
def l_index_follows(spark: SparkSession, sf: str) -> DataFrame:
    """An index of three quarters of the rows after two batches of changes: new, deleted and replaced rows."""
    df = documents(spark, sf).select("id", "title", "content")
    phrases = ["with", "worthless idiot", "the"]
    index = postings.Index(spark, f"{shared_dir(spark)}/index-follows-{uuid.uuid4().hex}", ("title", "content")).build(df.where("id % 4 <> 3"))
    other = df.where("id % 4 = 1").select("id", F.lit(False).alias("gone"), F.concat(F.lit("worthless idiot "), "title").alias("title"), F.lit(None).cast("string").alias("content"))
    index.apply_changes(df.where("id % 4 = 3").withColumn("gone", F.lit(False)).unionByName(other), 1)
    index.apply_changes(df.where("id % 4 = 2").withColumn("gone", F.lit(True)), 2)
    index.apply_changes(df.where("id % 4 = 2").withColumn("gone", F.lit(True)), 2)  # run again, as after a failure
    hit = F.array_compact(F.array(*[F.when(F.exists(F.col("tf")[i], lambda x: x > 0), F.lit(p)) for i, p in enumerate(phrases)]))
    return index.matches(phrases).select("id", F.explode(hit).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
