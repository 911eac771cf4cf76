"""Operations that go back by kind, and versions kept of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import keep_newest, quarantine_restore

#: Why a document does not go back.
MISSING, MODIFIED, ALIVE, DELETED, FINAL, REPEATED = "document_not_found", "modified_after_operation", "not_deleted", "already_deleted", "not_undoable", "already_undone"
GONE = "deleted_minute"


def _fields_back(fields: tuple[str, ...]) -> Callable:
    """Only while every field that the operation set still is as it left it."""

    def undo(state: Column, op: Column, at: int) -> tuple[Column, dict[str, Column]]:
        named = {f: F.array_contains(op["fields"], f) for f in fields}
        same = F.lit(True)
        for f, hit in named.items():
            same = same & (~hit | state[f].eqNullSafe(op["after"][f]))
        return F.when(~same, MODIFIED), {f: F.when(hit, op["before"][f]).otherwise(state[f]) for f, hit in named.items()}

    return undo


def _alive_again(state: Column, op: Column, at: int) -> tuple[Column, dict[str, Column]]:
    return F.when(state[GONE].isNull(), ALIVE), {GONE: F.lit(None).cast("long")}


def _deleted_again(state: Column, op: Column, at: int) -> tuple[Column, dict[str, Column]]:
    return F.when(state[GONE].isNotNull(), DELETED), {GONE: F.lit(at).cast("long")}


def _cover_back(state: Column, op: Column, at: int) -> tuple[Column, dict[str, Column]]:
    return F.lit(None).cast("string"), {"cover_path": op["before"]["cover_path"]}


def handlers(fields: tuple[str, ...]) -> dict[str, Callable]:
    """Kind of an operation -> how a document goes back; kinds that are not here stay as they are."""
    back = _fields_back(fields)
    return {"batch_update": back, "language_normalize": back, "batch_soft_delete": _alive_again, "directory_import": _deleted_again, "cover_upload": _cover_back}


def undone(current: DataFrame, log: DataFrame, fields: tuple[str, ...], at: int, key: str = "id", disk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, fields, deleted_minute of the documents that the log names, as they are after the undo;
    op, key, reason of each document of each operation, null where it went back).

    log: op long, kind, key, fields array<string> (those that the operation set), before and after (structs of the
    fields), undoable and undone booleans. A document's operations go back from the newest to the oldest, each judged on
    what the one before left; documents are independent, so one join and one grouping by document do the whole log.
    Files put away (`orphan_quarantine`, with path and stored) go back if disk (path) has them and their place is free.
    A document's operations in one log meet in one row.
    """
    known = handlers(fields)
    state_of = [F.col(f) for f in fields] + [F.col(GONE)]
    ops = log.where("kind <> 'orphan_quarantine'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("op", "kind", "fields", "before", "after", "undoable", "undone")), False).alias("_ops"))
    rows = ops.join(current.select(key, F.lit(True).alias("_there"), F.struct(*state_of).alias("_state")), key, "left")
    outcome = "array<struct<op: bigint, reason: string>>"
    kind = current.select(F.struct(*state_of).alias("s")).schema["s"].dataType.simpleString()
    start = F.struct(F.col("_state").cast(kind).alias("state"), F.array().cast(outcome).alias("out"))

    def step(acc: Column, op: Column) -> Column:
        state, reason, new = acc["state"], F.lit(FINAL), {n: acc["state"][n] for n in (*fields, GONE)}
        for k, undo in known.items():
            why, values = undo(state, op, at)
            hit = (op["kind"] == k) & op["undoable"]
            reason = F.when(hit, why).otherwise(reason)
            new = {n: F.when(hit, values[n]).otherwise(c) if n in values else c for n, c in new.items()}
        known_ops = op["kind"].isin(*known) & op["undoable"]
        reason = F.when(op["undone"], REPEATED).when(~known_ops, FINAL).when(state.isNull(), MISSING).otherwise(reason)
        done = F.when(reason.isNull(), F.struct(*[new[n].alias(n) for n in (*fields, GONE)])).otherwise(state)
        return F.struct(done.cast(kind).alias("state"), F.array_append(acc["out"], F.struct(op["op"].alias("op"), reason.alias("reason"))).alias("out"))

    folded = rows.select(key, "_there", F.aggregate("_ops", start, step).alias("r"))
    states = folded.where("_there").select(key, "r.state.*")
    outcomes = folded.select(F.explode("r.out").alias("o"), key).select("o.op", key, "o.reason")
    if disk is not None:
        files = log.where("kind = 'orphan_quarantine' AND undoable AND NOT undone")
        back = files.join(quarantine_restore(files.select("path", "stored"), disk), "path")
        outcomes = outcomes.unionByName(back.select("op", key, F.when(F.col("outcome") != "restored", F.col("outcome")).alias("reason")))
    return states, outcomes


def settled(outcomes: DataFrame) -> DataFrame:
    """op, status (undone, partial, not_undoable, already_undone), restored, skipped of each operation."""
    of = lambda r: F.count_if(F.col("reason") == r)
    rows = outcomes.groupBy("op").agg(F.count_if(F.col("reason").isNull()).alias("restored"), F.count("reason").alias("skipped"), of(FINAL).alias("_f"), of(REPEATED).alias("_r"))
    status = F.when(F.col("_r") > 0, REPEATED).when(F.col("_f") > 0, FINAL).when(F.col("skipped") > 0, "partial").otherwise("undone")
    none = F.col("_f") + F.col("_r") > 0
    return rows.select("op", status.alias("status"), F.when(none, 0).otherwise(F.col("restored")).cast("long").alias("restored"), F.when(none, 0).otherwise(F.col("skipped")).cast("long").alias("skipped"))


def versions(saves: DataFrame, key: str, at: str, texts: tuple[str, ...], forced: str | None = None, seconds: int = 30, most: int = 100) -> DataFrame:
    """key, at of the saves that become versions: not equal to the last kept one, not within `seconds` of it unless
    forced, the newest `most` of a key.

    Only digests of the texts are moved; saves are streamed by key and time, and what is held of a key is its last kept
    digest and time. Saves of one key and time go by digest; a null time is no save; null texts count as empty.
    """
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts])), 256)
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = saves.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), digest.alias("_d"), force.alias("_f")).where("_t IS NOT NULL")
    span, kind = seconds * 1_000_000, rows.schema[key].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, when, begun = None, None, 0, False
        for b in source:
            keep = []
            for k, t, d, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != now:
                    now, last, begun = k, None, True
                keep.append(last is None or (d != last and (f or t - when >= span)))
                if keep[-1]:
                    last, when = d, t
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=[key, "_t"]).filter(pa.array(keep))

    kept = rows.repartition(key).sortWithinPartitions(key, "_t", "_d").mapInArrow(run, f"`{key}` {kind}, _t long")
    return keep_newest(kept, key, [F.desc("_t")], most).select(key, F.timestamp_micros("_t").alias(at))
