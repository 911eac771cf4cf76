"""Folder listings, decoding, anchors, notes with wide blanks, quality names, restores, annotation files, previews."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import catalog, intake, notes, queue, review, upkeep, vectors
from corpusloom.operators.shelf_filter import ShelfFilter, status_predicate
from corpusloom.sources import listing


def tree(root):
    """Files in a sorted walk: (path, bytes)."""
    files = [("b.pdf", 5), ("empty.txt", 0), ("z.exe", 3), ("a/b.pdf", 5), ("a/page.html", 143), ("a/deep/b.pdf", 6), ("c/b.pdf", 5), ("c/no_ending", 9)]
    for path, size in files:
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    (root.parent / "outside").mkdir()
    (root.parent / "outside" / "secret.pdf").write_bytes(b"s")
    os.symlink(root.parent / "outside", root / "link")
    os.symlink(root.parent / "outside" / "secret.pdf", root / "linked.pdf")
    return files


def test_listing_keeps_empty_files_and_skips_links(spark, tmp_path):
    root = tmp_path / "books"
    root.mkdir()
    files = tree(root)
    got = {r["path"]: r for r in listing.scan(spark, str(root)).collect()}
    assert {p: r["size"] for p, r in got.items()} == dict(files) and not any(r["truncated"] for r in got.values())
    kinds = {p: (r["kind"], r["duplicate_of"]) for p, r in got.items()}
    assert kinds == {
        "b.pdf": ("importable", None), "empty.txt": ("bad", None), "z.exe": ("unsupported", None), "a/b.pdf": ("duplicate", "b.pdf"), "a/page.html": ("bad", None),
        "a/deep/b.pdf": ("importable", None), "c/b.pdf": ("duplicate", "b.pdf"), "c/no_ending": ("unsupported", None),
    }
    for most in (1, 3, 5, 8):
        part = listing.scan(spark, str(root), most).collect()
        assert {r["path"] for r in part} == {p for p, _ in files[:most]} and {r["truncated"] for r in part} == {most < len(files)}
    assert listing.scan(spark, str(tmp_path / "nowhere")).count() == 0


def test_decode_ladder(spark):
    rows = [("utf8", "数据 é".encode()), ("gb", "数据库系统".encode("gb18030")), ("latin", b"caf\xe9 \xff"), ("half", "数据".encode()[:4]), ("empty", b""), ("none", None), ("long", b"a" * 250_000)]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k string, b binary").select("k", listing.decoded(F.col("b")).alias("t")).collect()}
    half = "数据".encode()[:4]
    try:
        want = half.decode("gb18030")
    except UnicodeDecodeError:
        want = half.decode("latin-1")
    assert (got["utf8"], got["gb"], got["latin"], got["half"], got["empty"], got["none"], len(got["long"])) == ("数据 é", "数据库系统", "café ÿ", want, "", None, 200_000)


@pytest.mark.parametrize("anchor,want", [
    ('{"chapter": 0, "page": 7}', "章节 0"), ('{"page": 7}', "第 7 页"), ('{"chapter": "1", "page": 2}', "第 2 页"), ('{"chapter": 1.0}', ""), ('{"chapter": true}', ""), ('{"chapter": -1}', ""),
    ('{"page": 0}', ""), ("[1]", ""), ("", ""), (None, ""), ('{"chapter": [1], "page": {"page": 3}}', ""), ('{"chapter": 5, broken', ""),
])
def test_anchor_positions(spark, anchor, want):
    p = notes.place_in(F.lit(anchor).cast("string"))
    assert spark.range(1).select(notes.place_text(p["chapter"], p["page"])).first()[0] == want


def test_notes_with_wide_blanks_and_anchors(spark):
    marks = spark.createDataFrame([(1, 9, "　　", " 　", '{"page": 3}'), (2, 9, "one two\r\nthree", " mine　", None), (3, 9, "wide　　blank  here", "", '{"chapter": 2, "page": 1}')], "id long, document_id long, quote string, note string, anchor string")
    df = spark.createDataFrame([(9, "　Book ", False)], "id long, title string, deleted boolean")
    got = {r["annotation_id"]: (r["title"], r["content"]) for r in notes.notes(marks, df).collect()}
    assert got[1] == ("《Book》书签", "来源：[[Book]] · 第 3 页")
    assert got[2] == ("《Book》摘录：one two three", "> one\n> two\n> three\n\nmine\n\n来源：[[Book]]")
    assert got[3][0] == "《Book》摘录：wide blank here" and got[3][1].endswith(" · 章节 2")


def test_quality_names(spark):
    cols = "id long, content string, cover_path string, collection string, language string"
    df = spark.createDataFrame([(1, "x" * 600, "c", "k", "en"), (2, " ", None, None, "pt"), (3, "abc", "", "k", None), (4, "x" * 600, "c", "k", "")], cols)
    snapshot = spark.createDataFrame([(1, []), (2, ["needs_ocr", "missing_file"]), (4, ["duplicate_sha", "orphan_cover"])], "id long, issues array<string>")
    got = {r["id"]: list(r["quality"]) for r in catalog.quality_kinds(df, snapshot).collect()}
    assert got == {
        1: [], 2: ["empty_content", "no_cover", "unclassified", "language_variant", "needs_ocr", "missing_file", "issues"],
        3: ["short_content", "no_cover", "not_audited", "issues"], 4: ["duplicate", "issues"],
    }
    assert [r["id"] for r in catalog.of_quality(df, snapshot, "duplicate").collect()] == [4]
    with pytest.raises(ValueError):
        catalog.of_quality(df, snapshot, "odd")


def test_restores_refuse_values_of_other_types(spark):
    now = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, x double")
    old = spark.createDataFrame([("2", None, "7.5"), ("3", "c", None), ("x", "d", "1"), ("4", "e", "one")], "id string, name string, x string")
    after, counts = upkeep.restored_tables({"t": now, "u": now}, {"t": old}, {"t": "id"})
    assert sorted(map(tuple, after["t"].collect())) == [(1, "a", 1.0), (2, None, 7.5), (3, "c", None)] and after["u"].count() == 2
    assert [tuple(r) for r in counts.collect()] == [("t", 2, 2)]
    with pytest.raises(ValueError):
        upkeep.restored_tables({"t": now}, {"v": old}, {"v": "id"})


def test_annotation_file_is_one_table_in_order(spark, tmp_path):
    marks = spark.createDataFrame([(1, 9, "q\tq", "c\\d\ne", "highlight", 5), (2, 9, None, " note ", "note", 4), (3, 8, None, None, "bookmark", 1), (4, 7, "gone", None, "note", 1)], "id long, document_id long, quote string, content string, type string, created_minute long")
    df = spark.createDataFrame([(9, "B", False), (8, None, False), (7, "D", True)], "id long, title string, deleted boolean")
    upkeep.annotation_file(marks, df).write.text(str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "﻿front\tback\ttype\tbook\n\t— 《无标题》\tbookmark\t\nnote\t— 《B》\tnote\tB\nq\\tq\tc\\\\d\\ne\\n— 《B》\thighlight\tB\n"


def test_language_and_titles(spark):
    codes = ["EN-us", " zh_TW", "ja", None, " ", "pt-BR", "en"]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, language string")
    assert {(r["from_code"], r["to_code"]) for r in upkeep.language_changes(df).collect()} == {("EN-us", "en"), (" zh_TW", "zh"), (None, "und"), (" ", "und")}
    assert tuple(upkeep.language_report(df).first()) == (7, 4, 3, 1, 1)
    titles = spark.createDataFrame([("a",), ("",), (None,), ("b\x07",), ("1234567890",), ("123",), ("　",)], "t string")
    assert [tuple(r) for r in titles.select(T.fit_title(F.col("t")), T.title_rank(F.col("t"))).collect()] == [(True, 0), (False, 2), (False, 2), (False, 0), (True, 1), (True, 0), (True, 2)]


def test_previews_and_queue_changes(spark):
    state = F.struct(F.lit(7).alias("interval"), F.lit(1.9).alias("ease"), F.lit(5).alias("reps"), F.lit(0).alias("lapses"))
    assert tuple(spark.range(1).select(review.preview(state).alias("p")).first()["p"]) == ("10 分钟", "8 天", "13 天", "17 天")
    words = spark.createDataFrame([(0.2,), (90.5,), (1439.4,), (1439.6,), (2160.0,), (3600.0,)], "m double").select(review.interval_words(F.col("m")))
    assert [r[0] for r in words.collect()] == ["1 分钟", "90 分钟", "1439 分钟", "1 天", "2 天", "2 天"]
    items = spark.createDataFrame([(1, 11, 5, "n", "active", 0, 3, 3), (2, 12, 1, "m", "active", 0, 2, 2)], "id long, document_id long, priority long, note string, status string, sort_order int, created_minute long, updated_minute long")
    changes = spark.createDataFrame([(1, ["priority", "note"], 5000, "x" * 600, None), (2, ["status"], None, None, "odd"), (3, ["note"], None, "y", None), (4, [], None, None, None)], "id long, given array<string>, priority long, note string, status string")
    after, outcomes = queue.patched(items, changes, 9)
    rows = {r["id"]: r for r in after.collect()}
    assert (rows[1]["priority"], len(rows[1]["note"]), rows[1]["status"], rows[1]["updated_minute"]) == (1000, 500, "active", 9) and rows[2]["updated_minute"] == 2
    assert {r["id"]: r["outcome"] for r in outcomes.collect()} == {1: "updated", 2: "bad_status", 3: "not_found", 4: "not_found"}
    df = spark.createDataFrame([(11, "t", False), (12, "u", True)], "id long, title string, deleted boolean")
    assert queue.upcoming(items, df).first()["document_id"] == 11


def test_measures_of_queries_without_results(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, item string, rank int")
    judged = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a")], "query_id long, item string")
    got = {r["query_id"]: (r["hits"], r["precision"]) for r in vectors.retrieval_quality(ranked, judged, 2).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0)}


def test_filters_read_and_written():
    spec = ShelfFilter.parse({"q": "  two words ", "shelf": "odd", "sort": "nothing", "quality": "bad", "view": "list", "language": " EN-us ", "format": " PDF ", "author": "  ", "tag": None})
    assert spec == ShelfFilter(q="two words", view="list", language="en", format="pdf") and spec.written() == {"q": "two words", "format": "pdf", "language": "en", "view": "list"}
    recent = ShelfFilter.parse({"shelf": "recent", "sort": "title_asc"})
    assert recent.sort == "created_desc" and recent.written() == {"shelf": "recent"}
    for given in ({}, {"shelf": "done", "sort": "title_asc", "category": "c", "tag": "t", "quality": "issues"}):
        assert ShelfFilter.parse(given).written() == given and ShelfFilter.parse(ShelfFilter.parse(given).written()) == ShelfFilter.parse(given)


def test_filters_applied_and_left_out(spark):
    cols = "id long, title string, author string, content string, type string, format string, collection string, language string, progress double, deleted boolean, cover_path string"
    rows = [(1, "One", "A", "x" * 600, "book", "PDF", "c", "en", 0.5, False, "p"), (2, "Two", "B", "y", "book", "txt", "c", "zh-TW", None, False, None), (3, "One", "A", "", "pdf", "pdf", "d", "en", 1.0, False, "p"), (4, "One", "A", "z", "note", "pdf", "c", "en", 0.5, False, "p"), (5, "One", "A", "z", "book", "pdf", "c", "en", 0.5, True, "p")]
    df = spark.createDataFrame(rows, cols)
    bridge, snapshot = spark.createDataFrame([(1, "t"), (2, "t"), (1, "t")], "id long, tag string"), spark.createDataFrame([(1, [])], "id long, issues array<string>")
    ids = lambda given, **k: sorted(r["id"] for r in ShelfFilter.parse(given).rows(df, bridge, snapshot, **k).collect())
    assert ids({}) == [1, 2, 3] and ids({"q": "one"}) == [1, 3] and ids({"format": "pdf"}) == [1, 3] and ids({"language": "zh"}) == [2]
    assert ids({"shelf": "reading"}) == [1] and ids({"shelf": "unread"}) == [2] and ids({"shelf": "done"}) == [3] and ids({"shelf": "recent"}) == [1, 2, 3]
    assert ids({"tag": "t"}) == [1, 2] and ids({"tag": "t"}, without="tag") == [1, 2, 3]
    assert ids({"quality": "issues"}) == [2, 3] and ids({"quality": "not_audited", "author": "B"}) == [2] and ids({"quality": "issues", "category": "d"}, without="category") == [2, 3]
    with pytest.raises(ValueError):
        status_predicate("odd")


def test_readers_by_first_bytes(spark):
    rows = [("pdf", b"%PDF-1.7 x"), ("PDF", b"\n<!DOCTYPE html><p>a &amp; b</p>"), ("pdf", "数据".encode("gb18030")), ("epub", b"PK"), ("html", b"<html>raw</html>"), (None, b"caf\xe9 \xff"), ("txt", None), ("pdf", b"x" * 3000 + b"<html>")]
    got = intake.extracted(spark.createDataFrame(list((i, *r) for i, r in enumerate(rows)), "i int, format string, content binary")).orderBy("i").collect()
    assert [(r["reader"], r["text"]) for r in got] == [
        ("pdf", None), ("html", "a & b"), ("text", "数据"), ("book", None), ("text", "<html>raw</html>"), ("text", "café ÿ"), ("text", None), ("text", "x" * 3000 + "<html>"),
    ]
