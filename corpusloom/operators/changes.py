"""Versions, batch changes with undo, backups and their plans, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.state import decided


def keep_newest(df: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The newest `most` rows of a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def thinned(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """key, at of the rows that are kept when each must be `seconds` or more after the last kept one; rows are streamed."""
    return decided(df, [key], at, 1, seconds * 1_000_000 - 1).where("allowed").select(key, at)


def patch(current: DataFrame, changes: DataFrame, key: str, columns: list[str], given: str | None = None) -> DataFrame:
    """key, before struct, after struct: rows that a batch changes; null in the batch leaves a value as it is.

    `given` names a column array<string> of changes: then exactly the columns listed there are set, also to null.
    """
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *([F.col(given).alias("_given")] if given else []))
    joined = current.join(new, key)
    before = F.struct(*columns)
    value = lambda c: F.when(F.array_contains("_given", c), F.col(f"_{c}")).otherwise(F.col(c)) if given else F.coalesce(f"_{c}", c)
    after = F.struct(*[value(c).alias(c) for c in columns])
    return joined.select(key, before.alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def undo(current: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome, values: a row goes back only if it still is as the batch left it; else it is skipped with a reason."""
    now = current.select(key, F.struct(*columns).alias("now"))
    joined = log.join(now, key, "left")
    outcome = F.when(F.col("now").isNull(), "missing").when(F.col("now").eqNullSafe(F.col("after")), "undone").otherwise("changed since")
    return joined.select(key, outcome.alias("outcome"), F.when(outcome == "undone", F.col("before")).otherwise(F.col("now")).alias("values"))


def restore(current: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Upsert by key: rows of the backup replace the current ones, nulls included; columns it lacks stay."""
    columns = [c for c in current.columns if c != key]
    new = backup.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns if c in backup.columns])
    value = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in backup.columns else F.col(c)
    return current.join(new, key, "full").select(key, *[value(c).alias(c) for c in columns])


def backup_plan(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action: copy what is new or changed in size or time, keep what is the same, drop what is gone."""
    old = manifest.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    both = listing.select("path", "size", "mtime").join(old, "path", "full")
    action = F.when(F.col("size").isNull(), "drop").when(F.col("_s").isNull(), "new").when((F.col("size") != F.col("_s")) | (F.col("mtime") != F.col("_m")), "changed").otherwise("unchanged")
    return both.select("path", action.alias("action"))


def verify(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """path, state of each file of a manifest: ok, missing, size or hash."""
    now = listing.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    state = F.when(F.col("_s").isNull(), "missing").when(F.col("_s") != F.col("size"), "size").when(F.col("_h") != F.col("sha256"), "hash").otherwise("ok")
    return manifest.join(now, "path", "left").select("path", state.alias("state"))


def reconcile(disk: DataFrame, referenced: DataFrame, key: str = "path") -> DataFrame:
    """key, state: orphan on disk only, missing there though referenced."""
    a, b = disk.select(key).distinct(), referenced.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("orphan")).union(b.join(a, key, "left_anti").withColumn("state", F.lit("missing")))


def markdown_by_document(df: DataFrame, title: str, order: str, text: str) -> DataFrame:
    """title, markdown: the notes of a title under one heading, in order."""
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("- "), x[text])), "\n")
    return df.groupBy(title).agg(notes.alias("_n")).select(title, F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col("_n")).alias("markdown"))


def tsv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: the columns as one TSV line, cells free of tabs and line ends; write with write.text."""
    return df.select(F.concat_ws("\t", *[T.tsv_cell(F.col(c).cast("string")) for c in columns]).alias("line"))


def soft_delete(current: DataFrame, ids: DataFrame, at: int, key: str = "id") -> DataFrame:
    """key, before, after (deletion minute): live rows among the ids; deleted and unknown ones leave no trace."""
    return current.where(F.col("deleted_minute").isNull()).join(ids.select(key).distinct(), key, "left_semi").select(key, F.col("deleted_minute").alias("before"), F.lit(at).cast("long").alias("after"))


def unknown_ids(ids: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """The ids that no row has; a batch with any of them is refused."""
    return ids.select(key).distinct().join(current.select(key), key, "left_anti")


def log_record(log: DataFrame, kind: str, at: int, most: int = 500, key: str = "id") -> DataFrame:
    """One row: kind, at, status, n, ids (distinct, ascending, refused above `most`) of a batch's log."""
    ids = F.array_sort(F.collect_set(key))
    row = log.select(key).distinct().limit(most + 1).agg(ids.alias("ids"))
    checked = F.when(F.size("ids") > most, F.raise_error(F.lit(f"more than {most} ids"))).otherwise(F.size("ids"))
    return row.select(F.lit(kind).alias("kind"), F.lit(at).alias("at"), F.lit("done").alias("status"), checked.alias("n"), "ids")


def restored_version(current: DataFrame, versions: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """key, title, content of the rows set back to a version (wanted: key, version)."""
    return wanted.join(versions, [key, "version"]).join(current.select(key), key, "left_semi").select(key, "title", "content")


def quarantine_plan(files: DataFrame, referenced: DataFrame, most: int = 500, most_bytes: int = 5 << 30) -> DataFrame:
    """path, outcome: move, or why not: referenced again, too many, too large together. Smallest paths go first.

    Bytes are summed over the first `most` files alone.
    """
    rows = files.join(referenced.select("path", F.lit(True).alias("_r")).distinct(), "path", "left")
    free = rows.where("_r IS NULL").orderBy("path").limit(most).select("path", F.sum("size").over(Window.orderBy("path")).alias("_sum"))
    rows = rows.join(free, "path", "left")
    outcome = F.when(F.col("_r"), "referenced").when(F.col("_sum").isNull(), "too many").when(F.col("_sum") > most_bytes, "too large").otherwise("move")
    return rows.select("path", outcome.alias("outcome"))


def quarantine_restore(moved: DataFrame, disk: DataFrame) -> DataFrame:
    """path, outcome of bringing moved files (path, stored) back: restored, occupied or gone."""
    there = disk.select("path", F.lit(True).alias("_d")).distinct()
    rows = moved.join(there.withColumnRenamed("_d", "_taken"), "path", "left").join(there.withColumnRenamed("path", "stored"), "stored", "left")
    return rows.select("path", F.when(F.col("_d").isNull(), "gone").when(F.col("_taken").isNotNull(), "occupied").otherwise("restored").alias("outcome"))


def set_tags(bridge: DataFrame, wanted: DataFrame, mode: str = "add") -> DataFrame:
    """id, tags: sorted tags after `add`, `remove` or `set` of wanted (id, tags); ids without a request keep theirs."""
    old = bridge.groupBy("id").agg(F.collect_set("tag").alias("_old"))
    rows = old.join(wanted.select("id", F.col("tags").alias("_new")), "id", "full")
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("_old", "_new"))
    new = {"add": F.array_union(a, b), "remove": F.array_except(a, b), "set": F.array_distinct(b)}[mode]
    return rows.select("id", F.array_sort(F.when(F.col("_new").isNull(), a).otherwise(new)).alias("tags"))


def remaining(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows left after a hard delete."""
    return current.join(ids.select(key), key, "left_anti")


def insert_checked(current: DataFrame, new: DataFrame, unique: str, key: str = "id") -> DataFrame:
    """key, outcome of creating rows: created, or conflict where the unique column is taken, by a row or an earlier new one."""
    taken = current.select(unique, F.lit(True).alias("_t")).distinct()
    nth = F.row_number().over(Window.partitionBy(unique).orderBy(key))
    rows = new.select(key, unique, nth.alias("_n")).join(taken, unique, "left")
    return rows.select(key, F.when(F.col("_t").isNotNull() | (F.col("_n") > 1), "conflict").otherwise("created").alias("outcome"))


def operations(log: DataFrame, kind: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0, key: str = "id") -> DataFrame:
    """A page of the log's operations, newest first, ties by larger key, with the number of all that fit as `total`."""
    fit = log
    for name, wanted in (("kind", kind), ("status", status)):
        fit = fit.where(F.col(name) == wanted) if wanted else fit
    page = fit.orderBy(F.desc("created_at"), F.desc(key)).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(fit.agg(F.count("*").alias("total"))))  # one row
