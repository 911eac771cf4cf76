"""Undo by kind, versions and keyed streams against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import history
from corpusloom.streaming import keyed, state

T0 = dt.datetime(2024, 1, 1)
FIELDS = ("title", "cover_path")
SHAPE = "struct<title: string, cover_path: string>"


def plain_undo(docs, log, at):
    docs, out = {k: dict(v) for k, v in docs.items()}, []
    for op in sorted(log, key=lambda o: -o["op"]):
        d, kind = docs.get(op["id"]), op["kind"]
        if op["undone"]:
            reason = "already_undone"
        elif not op["undoable"] or kind == "reextract":
            reason = "not_undoable"
        elif d is None:
            reason = "document_not_found"
        elif kind in ("batch_update", "language_normalize"):
            reason = "modified_after_operation" if any(d[f] != op["after"][f] for f in op["fields"]) else None
            if reason is None:
                d.update({f: op["before"][f] for f in op["fields"]})
        elif kind == "batch_soft_delete":
            reason = None if d["gone"] is not None else "not_deleted"
            d["gone"] = None
        elif kind == "directory_import":
            reason = "already_deleted" if d["gone"] is not None else None
            d["gone"] = at if d["gone"] is None else d["gone"]
        else:
            reason = None
            d["cover_path"] = op["before"]["cover_path"]
        out.append((op["op"], op["id"], reason))
    return docs, out


def test_undo_equals_loop(spark):
    rng = random.Random(7)
    pick = lambda: rng.choice(["a", "b", None])
    docs = {i: {"title": pick(), "cover_path": pick(), "gone": rng.choice([None, None, 5])} for i in range(60)}
    kinds = ["batch_update", "language_normalize", "batch_soft_delete", "directory_import", "cover_upload", "reextract"]
    log = []
    for op in range(40):
        kind = rng.choice(kinds)
        for i in rng.sample(range(70), 12):
            values = [{"title": pick(), "cover_path": pick()} for _ in range(2)]
            log.append({"op": op, "kind": kind, "id": i, "fields": rng.choice([["title"], ["title", "cover_path"]]), "before": values[0], "after": values[1], "undoable": op % 9 != 0, "undone": op % 13 == 5})
    current = spark.createDataFrame([(i, d["title"], d["cover_path"], d["gone"]) for i, d in docs.items()], "id long, title string, cover_path string, deleted_minute long")
    table = spark.createDataFrame([tuple(o.values()) for o in log], f"op long, kind string, id long, fields array<string>, before {SHAPE}, after {SHAPE}, undoable boolean, undone boolean")
    states, outcomes = history.undone(current, table, FIELDS, 99)
    want, reasons = plain_undo(docs, log, 99)
    assert {r["id"]: {"title": r["title"], "cover_path": r["cover_path"], "gone": r["deleted_minute"]} for r in states.collect()} == {i: d for i, d in want.items() if any(o["id"] == i for o in log)}
    assert sorted(map(tuple, outcomes.collect()), key=repr) == sorted(reasons, key=repr)
    got = {r["op"]: r for r in history.settled(outcomes).collect()}
    for op in range(40):
        own = [r for o, _, r in reasons if o == op]
        if op % 13 == 5:
            assert (got[op]["status"], got[op]["restored"]) == ("already_undone", 0)
        elif "not_undoable" in own:
            assert (got[op]["status"], got[op]["skipped"]) == ("not_undoable", 0)
        else:
            assert got[op]["restored"] == own.count(None) and got[op]["status"] == ("undone" if set(own) == {None} else "partial")


def test_undo_of_nothing(spark):
    current = spark.createDataFrame([], "id long, title string, cover_path string, deleted_minute long")
    table = spark.createDataFrame([(1, "cover_upload", 5, [], None, None, True, False)], f"op long, kind string, id long, fields array<string>, before {SHAPE}, after {SHAPE}, undoable boolean, undone boolean")
    states, outcomes = history.undone(current, table, FIELDS, 1)
    assert states.count() == 0 and [tuple(r) for r in outcomes.collect()] == [(1, 5, "document_not_found")]


def test_versions_equal_loop(spark):
    rng = random.Random(3)
    saves = [(k, T0 + dt.timedelta(seconds=s), rng.choice(["t", None]), rng.choice(["x", "y", ""]), rng.random() < 0.2) for k in (1, 2, None) for s in rng.sample(range(4000), 300)]
    saves += [(3, None, "t", "x", True), (4, T0, "t", "x", False)]
    got = history.versions(spark.createDataFrame(saves, "id long, at timestamp, title string, content string, forced boolean").repartition(3), "id", "at", ("title", "content"), "forced", 30, 40)
    want = []
    for k in {s[0] for s in saves}:
        kept = []
        for _, at, t, c, forced in sorted((s for s in saves if s[0] == k and s[1] is not None), key=lambda s: s[1]):
            if not kept or ((t or "", c or "") != kept[-1][1] and (forced or (at - kept[-1][0]).total_seconds() >= 30)):
                kept.append((at, (t or "", c or "")))
        want += [(k, at) for at, _ in kept[-40:]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def calls(seed, n=160):
    """Batches in order of time; inside a batch the rows are shuffled."""
    rng, t, out = random.Random(seed), 0.0, []
    for _ in range(4):
        rows = []
        for _ in range(n // 4):
            t += rng.choice([0.5, 2, 9, 40])
            rows.append((rng.choice("abc"), T0 + dt.timedelta(seconds=t), rng.random() < 0.2))
        rng.shuffle(rows)
        out.append(rows)
    return out


def streamed(spark, tmp_path, batches, make, name):
    kind = "client string, ts timestamp, ok boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("kind", ["limited", "locked", "thinned"])
def test_streams_equal_finished_logs_and_forget(spark, tmp_path, kind):
    batches = calls(11)
    end = batches[-1][0][1] + dt.timedelta(hours=5)
    batches += [[("later", end, True)], [("later", end + dt.timedelta(seconds=1), False)]]  # moves the watermark past every end
    make = {
        "limited": lambda s: keyed.limited_stream(s, "client", "ts", 3, 20, "10 minutes"),
        "locked": lambda s: keyed.locked_out_stream(s, "client", "ts", "ok", 3, 60, "10 minutes"),
        "thinned": lambda s: keyed.thinned_stream(s, "client", "ts", 15, "10 minutes"),
    }[kind]
    got = streamed(spark, tmp_path, batches, make, f"mem_{kind}")
    log = spark.createDataFrame([r for b in batches for r in b], "client string, ts timestamp, ok boolean")
    if kind == "limited":
        want = state.limited(log, ["client"], "ts", 3, 20)
    elif kind == "locked":
        want = state.locked_out(log, "client", "ts", "ok", 3, 60)
    else:
        from corpusloom.operators.changes import thinned

        want = thinned(log, "client", "ts", 15)
    assert got == sorted(map(tuple, want.collect()))
    kept = spark.read.format("statestore").option("stateVarName", "times").load(f"{tmp_path}/cp").select(F.col("key.client").alias("k"))
    assert {r["k"] for r in kept.collect()} <= {"later"}


def test_arrivals_as_a_stream(spark, tmp_path):
    for i, rows in enumerate([[("a", 0), ("b", 1), ("a", 2)], [("b", 3), ("c", 4)], [("a", 5)]]):
        spark.createDataFrame([(d, T0 + dt.timedelta(seconds=s)) for d, s in rows], "digest string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema("digest string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = state.arrivals(stream, "digest", "at").writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and sorted(r["digest"] for r in spark.table("arrived").collect()) == ["a", "b", "c"]
