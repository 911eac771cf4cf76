"""Small goldens: scheduling, scores, terms, streams, listings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, catalog, changes, exports, graph, listing, local, review, search, vectors
from corpusloom.sources.tables import files
from corpusloom.streaming import state


CARD = {"interval": 7, "ease": 1.9, "reps": 5, "lapses": 0}


@pytest.mark.parametrize("rating,want", [(1, (0, 1.7, 0, 1)), (2, (8, 1.75, 6, 0)), (3, (13, 1.9, 6, 0)), (4, (17, 2.05, 6, 0))])
def test_schedule_step(spark, rating, want):
    s = F.struct(*[F.lit(v).alias(k) for k, v in CARD.items()])
    got = spark.range(1).select(review.step(s, F.lit(rating)).alias("s")).first()["s"]
    assert (got.interval, round(got.ease, 6), got.reps, got.lapses) == want
    assert review.rated(*CARD.values(), rating)[0] == want[0]


def test_schedule_bounds_and_due(spark):
    s = F.struct(F.lit(2_000_000).alias("interval"), F.lit(2.8).alias("ease"), F.lit(9).alias("reps"), F.lit(0).alias("lapses"))
    row = spark.range(1).select(*[review.step(s, F.lit(r))["interval"].alias(f"r{r}") for r in (1, 2, 3, 4)]).first()
    assert tuple(row) == (0, 2_400_000, review.MOST_DAYS, review.MOST_DAYS)
    s = F.struct(F.lit(390).alias("interval"), F.lit(2.3).alias("ease"), F.lit(9).alias("reps"), F.lit(0).alias("lapses"))
    assert spark.range(1).select(review.step(s, F.lit(3))["interval"]).first()[0] == 896
    cards = spark.createDataFrame([("a", 10, 2.0, 3, 0), ("b", 10, 2.0, 3, 0)], "card string, interval int, ease double, reps int, lapses int")
    at = dt.datetime(2024, 5, 1, 12)
    got = {r.card: r for r in review.rate(cards, spark.createDataFrame([("a", 3, at), ("b", 1, at)], "card string, rating int, at timestamp"), "card", "at").collect()}
    assert got["a"].due_at == dt.datetime(2024, 5, 21, 12) and got["b"].due_at == dt.datetime(2024, 5, 1, 12, 10)
    with pytest.raises(ValueError):
        review.snooze(F.col("x"), F.col("y"), 2)


def test_schedule_fold(spark):
    rows = [(k, i, 1 + (i * i + len(k)) % 4) for k in ("a", "bb", "ccc") for i in range(40)] + [(None, 0, 4)]
    df = spark.createDataFrame(rows, "k string, i int, rating int")
    want = {}
    for k, _, r in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        want[k] = review.rated(*want.get(k, (0, 2.5, 0, 0)), r)
    got = {r.k: (r.interval, r.ease, r.reps, r.lapses) for r in review.fold_ratings(df, "k", ["i"], "rating").collect()}
    assert got == want and want[None] == (4, 2.65, 1, 0)
    assert review.fold_ratings(df.limit(0), "k", ["i"], "rating").count() == 0


def test_exact_top_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.exact_top(df, df, 3, most_queries=7).collect()}
    for q in range(60):
        by = sorted((-(i % 7) * (q % 7) - (i % 11) * (q % 11), i) for i in range(60) if i != q)
        assert [got[q, r] for r in (1, 2, 3)] == [i for _, i in by[:3]]
    assert len(got) == 180


def test_exact_top_by_chunks(spark, monkeypatch):
    """Chunks and blocks against the plain order of all pairs, with copies, ties and vectors that have no usual score."""
    monkeypatch.setattr(vectors, "CHUNK", 16)
    odd = [None, [1.0], [float("nan"), 0.0, 1.0], [None, 1.0, 1.0], [1e200, 1.0, 0.0]]
    rows = [(i, [((i * 7) % 5) / 3, ((i * 3) % 11) / 7, 1.0]) for i in range(90)] + [(90 + i, v) for i, v in enumerate(odd)] + [(None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vectors.exact_top(df, df.where("vec_id % 10 = 0 OR vec_id > 90"), 4, most_queries=5)
    got = [(r.query_id, r.vec_id, r["rank"]) for r in out.collect()]
    q = df.where("vec_id % 10 = 0 OR vec_id > 90").selectExpr("vec_id AS query_id", "embedding AS q")
    pairs = df.crossJoin(q).where("vec_id <> query_id").withColumn("score", vectors.dot(F.col("embedding"), F.col("q")))
    want = pairs.selectExpr("query_id", "vec_id", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where("rank <= 4")
    assert sorted(got) == sorted(map(tuple, want.collect()))
    assert vectors.exact_top(df, df.limit(0), 4).count() == 0


def test_fuzzy(spark):
    # abc at the start: 2 + 4 + 4; with gaps: 2 + 1 + 1; later start: 1 + 2 + 4; each less a hundredth of the length
    want = {"abc": 9.97, "axbxc": 3.95, "xabc": 6.96, "cab": None, "": None}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    got = {r.w: r.s for r in df.select("w", search.fuzzy_score(F.col("w"), "aBc").alias("s")).collect()}
    assert {k: v and round(v, 6) for k, v in got.items()} == want
    assert {r.s for r in df.select(search.fuzzy_score(F.col("w"), "").alias("s")).collect()} == {1.0}


def test_terms():
    assert search.query_terms("Where do rivers and lakes meet?") == ["rivers", "lakes", "meet"]
    assert search.query_terms("salt Salt SALT water") == ["salt", "water"]
    assert search.query_terms("?! -") == []
    assert search.recall_windows("abcdef") == [] and search.recall_windows("春夏秋冬雨") == ["春夏秋冬", "夏秋冬雨", "春夏秋", "夏秋冬", "秋冬雨"]


def test_recall_and_index(spark):
    df = spark.createDataFrame([(1, "t", "the 春夏秋冬 of it"), (2, "春夏", None), (3, "other", "text")], "id long, title string, content string")
    index = search.gram_index(df, ("title", "content"))
    assert [r.id for r in search.recalled(df, ["春夏秋冬雨"], ("title", "content"), index).collect()] == [1]
    assert [r.id for r in search.recalled(df, ["xyz"], ("title", "content"), index).collect()] == []
    assert search.index_lag(index, df, ("title", "content")).count() == 0


def test_lockout(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=(i * i * 13) % 400), (i + len(k)) % 7 == 0) for k, n in (("a", 120), ("bb", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, good boolean")
    want = []
    for k in ("a", "bb"):
        failed = []
        for t, good in sorted((t, g) for c, t, g in rows if c == k):
            failed = [x for x in failed if (t - x).total_seconds() <= 60]
            want.append((k, t, len(failed) >= 4))
            if len(failed) < 4:
                failed = [] if good else [*failed, t]
    got = [(r.client, r.ts.replace(tzinfo=None), r.locked) for r in state.locked_out(df, "client", "ts", "good", 4, 60).collect()]
    assert sorted(got) == sorted(want) and {x[2] for x in want} == {True, False}


def test_batch_can_set_null(spark):
    now = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id long, v string, w string")
    new = spark.createDataFrame([(1, None, None, ["v"]), (2, "z", None, [])], "id long, v string, w string, given array<string>")
    assert [(r.id, tuple(r.after)) for r in changes.patch(now, new, "id", ["v", "w"], "given").collect()] == [(1, (None, "p"))]
    back = spark.createDataFrame([(1, None), (3, "n")], "id long, v string")
    assert sorted(map(tuple, changes.restore(now, back, "id").collect()), key=str) == [(1, None, "p"), (2, "y", "q"), (3, "n", None)]


def test_minutes_round_half_even(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, t + dt.timedelta(seconds=15)), (t, t - dt.timedelta(seconds=9))], "a timestamp_ntz, b timestamp_ntz")
    assert review.minutes_by_day(df, "a", "b").first().minutes == 0.2


def test_refusals(spark):
    with pytest.raises(ValueError):
        catalog.sort(spark.range(1), "by_colour")
    with pytest.raises(ValueError):
        catalog.snapshot_arm(spark.range(1), spark.range(1), "other")
    with pytest.raises(Exception, match="more than 3 ids"):
        changes.log_record(spark.range(5), "x", 1, 3).collect()


def test_languages(spark):
    codes = {"en-US": "en", "eng": "en", "EN-US": "en", "zh-TW": "zh", "CHS ": "zh", "pt-BR": "pt-br", "": "und", None: "und", "fr": "fr"}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.n for r in df.select("c", T.language(F.col("c")).alias("n")).collect()} == codes


def test_limiter_edges(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 10, 11, 12)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz")
    got = [r.allowed for r in state.limited(df, ["client"], "ts", 2, 10).orderBy("ts").collect()]
    assert got == [True, True, False, False, True, True]


def test_limits_hold_no_group(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=(i * i * 7) % 997)) for k, n in (("a", 300), ("b", 5), (None, 20)) for i in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz")
    calls, kept = state.limited(df, ["client"], "ts", 3, 10), changes.thinned(df, "client", "ts", 10)
    want_calls, want_kept = [], []
    for k in ("a", "b", None):
        live, last = [], None
        for t in sorted(t for c, t in rows if c == k and t):
            ok = sum((t - x).total_seconds() <= 10 for x in live) < 3
            live += [t] if ok else []
            want_calls.append((str(k), t, ok))
            if last is None or (t - last).total_seconds() >= 10:
                last = t
                want_kept.append((str(k), t))
    assert sorted((str(r.client), r.ts.replace(tzinfo=None), r.allowed) for r in calls.collect()) == sorted(want_calls)
    assert sorted((str(r.client), r.ts.replace(tzinfo=None)) for r in kept.collect()) == sorted(want_kept)
    for out in (calls, kept):
        assert "collect_list" not in out._jdf.queryExecution().toString()


def test_limiter_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 10, 11, 12)]
    spark.createDataFrame(rows, "client string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in"))
    q = state.limited_stream(stream, "client", "ts", 2, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.allowed for r in spark.table("limited").orderBy("ts").collect()] == [True, True, False, False, True, True]


def test_mentions_and_graph(spark):
    df = spark.createDataFrame([(1, "A", "see [[B]] and [[ B ]] and [[C]]"), (2, "B", "back to [[A]]"), (3, "B", "[[B]]"), (4, None, None)], "id long, title string, content string")
    edges = graph.mention_edges(df)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (1, 3), (2, 1), (3, 2)}
    assert {r.node for r in graph.orphans(df.select(F.col("id").alias("node")), edges).collect()} == {4}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert any(r.node == r.ancestor for r in graph.ancestors(cycle, 3).collect())


def test_containment_paths_agree(spark):
    df = spark.createDataFrame([(1, "a long text with some words"), (2, "nothing"), (3, None)], "id long, content string")
    titles = spark.createDataFrame([(7, "some words"), (8, "th"), (9, "long text with some words and"), (10, "x")], "title_id long, title string")
    want = {(1, 7), (1, 8), (2, 8)}
    for few in (100, 0):
        assert {tuple(r) for r in graph.contained(df, titles, 6, few).collect()} == want


def test_audit_nulls(spark):
    df = spark.createDataFrame([(1, None, "en", "c"), (2, "abc", "en-US", None), (3, "abc", "en", "c")], "id long, content string, language string, collection string")
    got = {r.id: r.issues for r in audit.audit(df).collect()}
    assert got == {1: ["empty"], 2: ["short", "unclassified", "language_variant", "duplicate"], 3: ["short", "duplicate"]}


def test_undo_and_restore(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, v string")
    log = changes.patch(now, spark.createDataFrame([(1, "n"), (2, None), (9, "q")], "id long, v string"), "id", ["v"])
    assert [(r.id, r.before.v, r.after.v) for r in log.collect()] == [(1, "x", "n")]
    back = changes.undo(spark.createDataFrame([(1, "n")], "id long, v string"), log, "id", ["v"]).first()
    assert (back.outcome, back["values"].v) == ("undone", "x")


def test_filters_refuse_unknown():
    with pytest.raises(ValueError):
        listing.quality_predicate("other")


def test_file_listing(spark, tmp_path):
    for name, size in (("a/x.txt", 10), ("b/x.txt", 10), ("a/y.txt", 143), ("a/z.bin", 5)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"1" * size)
    got = sorted((r.name, r.kind) for r in files(spark, str(tmp_path)).collect())
    assert got == [("x.txt", "duplicate"), ("x.txt", "importable"), ("y.txt", "bad"), ("z.bin", "unsupported")]


def test_addresses_against_ipaddress(spark):
    import ipaddress
    import random

    from corpusloom.operators import addresses

    rnd = random.Random(5)
    ips = [str(ipaddress.ip_address(rnd.randrange(1 << 32))) for _ in range(150)] + [f"{a}.{b}.0.1" for a in (10, 100, 172, 192, 198) for b in (0, 15, 16, 18, 31, 32, 64, 127, 168)]
    ips += [str(ipaddress.ip_address(rnd.getrandbits(128) & ~(((1 << rnd.choice((16, 64, 100))) - 1) << 10))) for _ in range(150)]
    ips += ["::1", "::", "::2", "fc00::1", "fdff::", "fe80::1", "febf::1", "fec0::", "64:ff9b::102:304", "64:ff9b:1::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2002:a00:1::", "2002:808:808::"]
    bad = ["", "1.2.3", "1.2.3.256", "host", "1:2", ":::", "1::2::3", "12345::", "01.2.3.4"]

    def want(ip):
        x = ipaddress.ip_address(ip)
        if x.version == 6:
            x = x.ipv4_mapped or x.sixtofour or x
        return any(x in ipaddress.ip_network(n) for n in addresses.BLOCKED_V4 + addresses.BLOCKED_V6)

    rows = spark.createDataFrame([(x,) for x in ips + bad], "ip string").select("ip", addresses.blocked(F.col("ip"))).collect()
    assert {r[0]: r[1] for r in rows} == {x: want(x) for x in ips} | dict.fromkeys(bad)
    urls = {"http://a.org": None, "HTTPS://u:p@a.org:8443/x?y": None, "http://a.org:22": "port", "http://127.0.0.1/": "address", "ftp://a.org": "scheme", "http:///x": "host", None: "scheme", "http://[::1]:80/": "address"}
    rows = spark.createDataFrame([(x,) for x in urls], "u string").select("u", addresses.refusal(F.col("u"))).collect()
    assert dict(map(tuple, rows)) == urls


def test_cut_chunks(spark):
    from corpusloom.operators import vectors

    texts = {1: "x" * 199, 2: None, 3: "y" * 2000, 4: ("word " * 30 + "end. ") * 20, 5: "z" * 700 + "." + "z" * 500, 6: "q" * 200000, 7: "z" * 500 + "." + "z" * 700, 8: "a\r\n\r\n\r\n\r\nb　　c" + "d" * 300}
    got = {}
    for r in spark.createDataFrame(list(texts.items()), "id long, content string").transform(vectors.cut_chunks).orderBy("id", "idx").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert set(got) == {3, 4, 5, 6, 7, 8}
    assert [len(x) for x in got[3]] == [800, 800, 640]
    assert [len(x) for x in got[5]] == [701, 620] and got[5][0].endswith(".")
    assert [len(x) for x in got[7]] == [800, 521]
    assert len(got[6]) == 200 and all(len(x) == 800 for x in got[6])
    assert all(x.endswith("end.") for x in got[4][:-1]) and got[8][0].startswith("a\n\nb cd")
    assert spark.createDataFrame([], "id long, content string").transform(vectors.cut_chunks).count() == 0


def test_numbered_in_ranges(spark):
    rows = [(i, None if i % 9 == 0 else i * 7 % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at long")
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    for each in (20, 1000):
        assert {r.id: r.nth for r in exports.numbered(df, "at", rows_each=each).collect()} == want
    assert exports.numbered(df.limit(0), "at").count() == 0


def test_file_names(spark):
    df = spark.createDataFrame([(7, ' a/b:\n "c" '), (1234, None), (8, "x" * 90)], "n long, t string")
    assert [r[0] for r in df.select(exports.file_name(F.col("n"), F.col("t"))).collect()] == ["007-a b c.md", "1234-无标题.md", f"008-{'x' * 60}.md"]


def test_backup_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(1, "ü\n\"", None), (2, None, 0.5)], "id long, t string, x double")
    two = spark.createDataFrame([], "k string")
    exports.write_backup({"one": one, "two": two}, str(tmp_path / "b"))
    back = exports.read_backup(spark, str(tmp_path / "b"))
    assert sorted(back) == ["one", "two"] and back["two"].count() == 0
    assert sorted(map(tuple, back["one"].collect())) == [(1, "ü\n\"", None), (2, None, 0.5)]


def test_local_shelf(spark):
    rows = [(1, "B", None, None, "zh_CN", 100.0, None, ["x"]), (2, "a", "Ann", "pdf", "zh", 3.0, 9, None), (3, None, "ann", "PDF", None, None, 5, [])]
    df = spark.createDataFrame(rows, "id long, title string, author string, format string, language string, progress double, last_read_at long, tags array<string>")
    df = df.selectExpr("*", "'' AS publisher", "cast(NULL AS string) AS description", "'c' AS category", "id AS added_at")
    ids = lambda **k: sorted(r.id for r in local.matches(df, **k).collect())
    assert ids() == ids(shelf="recent") == ids(category="c") == [1, 2, 3]
    assert ids(search=" ANN ") == [2, 3] and ids(author="Ann") == [2] and ids(format="Pdf") == [2, 3] and ids(tag="x") == [1]
    assert ids(shelf="done") == [1] and ids(shelf="reading") == [2] and ids(shelf="unread") == [3] and ids(category="d") == []
    order = lambda name: [r.id for r in local.sort(df, name).collect()]
    assert order("last_read_desc") == [2, 3, 1] and order("created_desc") == order("other") == [3, 2, 1] and order("title_asc") == [3, 2, 1]
