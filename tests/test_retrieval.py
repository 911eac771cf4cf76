"""Positional index, questions, answers and keywords against scans and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, questions, retrieval, search

WORDS = ["机器学习", "模型", "学习", "人工智能", "alpha", "beta", "Alphabet", "机", "é", "aaa", "aaaa", "C++", "x"]


def texts(n, seed):
    rng = random.Random(seed)
    one = lambda k: None if rng.random() < 0.1 else "".join(rng.choice(WORDS) + rng.choice(["", " ", "", "，", "\n"]) for _ in range(rng.randint(0, k)))
    return [(i, one(4), one(60)) for i in range(n)]


def occurrences(text, phrase):
    return (text or "").lower().count(phrase.lower())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = texts(300, 1) + [(900, "long", "alpha " * 3000 + "机器" * 2000), (901, "", ""), (902, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, content string").repartition(3)
    at = str(tmp_path_factory.mktemp("index"))
    small = postings.PART_ROWS
    postings.PART_ROWS = 50  # several parts in a task; the closure carries the module's value of the driver only where it is read there
    out = {n: postings.Index(spark, f"{at}/{n}", ("title", "content"), analyzer=a).build(df) for n, a in (("grams", postings.Grams()), ("runs", postings.Runs()))}
    postings.PART_ROWS = small
    return rows, df, out


@pytest.mark.parametrize("kind,phrases", [
    ("grams", ["机器学习", "学习模", "alpha", "aaa", "aaaa", "lphabe", "a b", "c++", "zzz", "ALPHA\nbeta"]),
    ("runs", ["机器", "器学", "机器学习", "学", "人工智能", "智能模型", "学习学", "习机器学"]),
])
def test_counts_equal_substrings(indexed, kind, phrases):
    rows, _, index = indexed
    got = {r["id"]: [list(t) for t in r["tf"]] for r in index[kind].matches(phrases).collect()}
    want = {i: [[occurrences(t, p), occurrences(c, p)] for p in phrases] for i, t, c in rows}
    assert got == {i: tf for i, tf in want.items() if any(map(any, tf))}


def test_runs_find_whole_words(indexed):
    rows, _, index = indexed
    whole = lambda t: sum(m.group() == "alpha" for m in re.finditer(rf"[{postings.CJK}]+|[^\s{postings.CJK}]+", (t or "").lower()))
    got = {r["id"]: sum(map(sum, r["tf"])) for r in index["runs"].matches(["Alpha"]).collect()}
    assert got == {i: n for i, t, c in rows if (n := whole(t) + whole(c))}
    found = re.compile(rf"机\salpha(?![^\s{postings.CJK}])")  # a blank stands for any white space of its length
    assert index["runs"].matches(["机 alpha"]).count() == sum(any(found.search((x or "").lower()) for x in tc) for _, *tc in rows)


def test_scores_equal_scan_and_sizes(indexed):
    rows, df, index = indexed
    assert index["grams"].size()[0] == len(rows)
    terms, weights = ["alpha", "学习模", "aaa"], [5.0, 1.0]
    scan = search.bm25(df, terms, {"title": 5.0, "content": 1.0})
    want = {r["id"]: (round(r["score"], 9), r["hit_terms"]) for r in scan.collect()}
    got = index["grams"].scored(terms, weights).collect()
    assert {r["id"]: (round(r["score"], 9), r["hit_terms"]) for r in got} == want
    low = {i: ((t or "").lower(), (c or "").lower()) for i, t, c in rows}
    assert all(r["field"] == (0 if any(x in low[r["id"]][0] for x in terms) else 1) for r in got)
    top = [r["id"] for r in index["grams"].top(terms, weights, 7).collect()]
    assert top == [i for i, _ in sorted(want.items(), key=lambda x: (-x[1][0], x[0]))][:7]


def test_short_phrases_are_refused_and_lists_pruned(indexed):
    _, _, index = indexed
    with pytest.raises(ValueError):
        index["grams"].matches(["ab"])
    plan = index["grams"].rows(["alp"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "In(term" in plan or "EqualTo(term" in plan


def test_changes_and_a_replayed_stream(spark, tmp_path, indexed):
    """New, replaced and deleted documents; the stream's last batch runs twice, as after a lost driver."""
    rows, df, _ = indexed
    rng = random.Random(4)
    index = postings.Index(spark, f"{tmp_path}/ix", ("title", "content")).build(df)
    state = {i: (t, c) for i, t, c in rows}
    for nth in range(3):
        batch = [(i, rng.random() < 0.3, "alpha new", rng.choice(["机器学习 aaa", None, "beta"]), k) for k, i in enumerate(rng.choices([*range(0, 300, 7), 5000 + nth, 6000], k=25))]
        for i, gone, t, c, _ in batch:
            state.pop(i, None) if gone else state.__setitem__(i, (t, c))
        spark.createDataFrame(batch, "id long, gone boolean, title string, content string, at long").coalesce(1).write.parquet(f"{tmp_path}/in/b{nth}")

    def run():
        stream = spark.readStream.schema("id long, gone boolean, title string, content string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = index.follow(stream, "at", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    def held():
        return {r["id"]: [list(t) for t in r["tf"]] for r in index.matches(["alpha", "aaa"]).collect()}

    run()
    first, want = held(), {i: [[occurrences(x, p) for x in tc] for p in ("alpha", "aaa")] for i, tc in state.items()}
    assert first == {i: tf for i, tf in want.items() if any(map(any, tf))}
    assert index.size()[0] == len(state)
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # the last batch was written, not committed
    (tmp_path / "cp" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert held() == first and index.size()[0] == len(state)


def test_recall_names_both_sides(spark, indexed):
    rows, df, index = indexed
    changed = df.where("id <> 900").union(spark.createDataFrame([(7777, "alpha", "")], df.schema))
    got = {r["phrase"]: r for r in postings.recall(index["grams"], changed, ["alpha", "学习模", "nowhere"]).collect()}
    truth = sum(bool(occurrences(t, "alpha") or occurrences(c, "alpha")) for i, t, c in rows if i != 900) + 1
    assert got["alpha"].asDict() == {"phrase": "alpha", "truth": truth, "found": truth, "missing": 1, "extra": 1, "recall": pytest.approx((truth - 1) / truth)}
    assert got["学习模"]["recall"] == 1.0 and got["nowhere"]["recall"] == 1.0 and got["nowhere"]["truth"] == 0


@pytest.mark.parametrize("question,want", [
    ("", []),
    ("the of and", []),
    ("Spark 与 SPARK join", ["Spark", "join"]),
    ("天气好吗", ["天气好吗", "天气好"]),
    ("天气很好吗", ["天气", "好吗"]),
    ("数据仓库和数据湖", ["数据仓库", "数据湖"]),
    ("什么是列式存储", ["列式存储"]),
    ("为什么", ["为什么"]),
    ("GPU显存优化 a 1.0", ["显存优化", "GPU", "1.0"]),
    ("人民广场", ["人民广场"]),
    ("对比学习的损失", ["对比学习", "比学习", "损失"]),
    ("如何看待音乐是语言", ["看待音乐", "语言"]),
    ("一二三四五 六七 八", ["一二三四五", "六七"]),
    ("one two three four five six seven eight", ["one", "two", "three", "four", "five", "six"]),
])
def test_questions_as_terms(question, want):
    assert questions.terms(question) == want


def test_windows_of_long_terms():
    assert questions.windows(["一二三四五", "abcdefgh"]) == ["一二三四", "一二三", "二三四五", "二三四", "三四五"]
    assert questions.windows(["一二三四", "abc"]) == []


def plain_keywords(text, most=5):
    from collections import Counter

    n = Counter(w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_-]+", text or ""))
    for run in re.findall("[一-鿿]+", text or ""):
        n.update(run[i : i + 2] for i in range(len(run) - 1))
    out = []
    for w, _ in sorted(((w, c) for w, c in n.items() if w not in retrieval.COMMON), key=lambda x: (-x[1], x[0])):
        if len(out) < most and not any(w in p or p in w for p in out):
            out.append(w)
    return out


def test_keywords_equal_loop(spark):
    rows = [(i, c) for i, _, c in texts(120, 9)] + [(500, "the the the"), (501, "a-b a-b ab abc abcd The"), (502, "数据 数据库 数据库表"), (503, "")]
    got = spark.createDataFrame(rows, "id long, c string").select("id", retrieval.keywords(F.col("c")).alias("k")).collect()
    assert {r["id"]: list(r["k"]) for r in got} == {i: plain_keywords(c) for i, c in rows}


def plain_snippet(text, terms, width=80):
    flat = re.sub(r"\s+", " ", text or "").strip()
    low, found = flat.lower(), []
    for i, t in enumerate(terms):
        at = low.find(t.lower())
        if at >= 0:
            found.append((max(0, at - width // 3), i, at, len(t)))
    if not found:
        out = flat[:width] + ("…" if len(flat) > width else "")
    else:
        start, _, at, n = min(found)
        end = min(len(flat), at + n + width)
        own = next(len(t) for t in terms if low[at:].startswith(t.lower()))
        out = ("…" if start else "") + flat[start:at] + "<mark>" + flat[at : at + own] + "</mark>" + flat[at + own : end] + ("…" if end < len(flat) else "")
    if len(out) <= 220:
        return out
    head = out[:212]
    return head + ("</mark>" if head.count("<mark>") > head.count("</mark>") else "") + "…"


def test_snippets_equal_loop(spark):
    rows = [(i, c) for i, _, c in texts(150, 3)] + [(800, "x " * 100 + "ALPHA" + " y" * 100), (801, "alphabet " * 50), (802, None)]
    terms = ["alphabet", "alpha", "模型", "a" * 250]
    got = spark.createDataFrame(rows, "id long, c string").select("id", retrieval.snippet(F.col("c"), terms).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {i: plain_snippet(c, terms) for i, c in rows}
    long = spark.createDataFrame([("b" * 300,)], "c string").select(retrieval.snippet(F.col("c"), ["b" * 230]).alias("s")).first()["s"]
    assert len(long) == 220 and long.endswith("</mark>…")


def test_answers_fill_and_fall_back(spark, indexed):
    rows, df, index = indexed
    df = df.withColumn("updated_minute", F.col("id") % 5).withColumn("type", F.when(F.col("id") % 2 == 0, "note").otherwise("book"))
    page = retrieval.answer(index["grams"], df, "alpha 学习", [5.0, 1.0], 400).orderBy("nth").collect()
    hit = lambda r, t: any(t in (x or "").lower() for x in r[1:])
    long, short = {r[0] for r in rows if hit(r, "alpha")}, {r[0] for r in rows if hit(r, "学习")}
    assert [r["nth"] for r in page] == list(range(1, len(page) + 1)) and {r["id"] for r in page} == long | short
    assert all("<mark>" in r["snippet"] or r["id"] == 900 for r in page)
    ordered = [r["id"] for r in retrieval.answer(index["grams"], df, "alpha", [5.0, 1.0], 30).orderBy("nth").collect()]
    scored = {r["id"]: (-r["hit_terms"], r["field"], -r["best"], -(r["id"] % 5), r["id"]) for r in index["grams"].scored(["alpha"], [5.0, 1.0]).collect()}
    assert ordered == sorted(scored, key=scored.get)[:30]
    fallen = retrieval.answer(index["grams"], df, "看机器学习书", [5.0, 1.0], 500).collect()
    assert {r["id"] for r in fallen} == {r[0] for r in rows if hit(r, "机器学习") or hit(r, "器学习")} and fallen
    assert retrieval.answer(index["grams"], df, "the", [5.0, 1.0]).count() == 0
    one = retrieval.summary(index["grams"], df, ["alpha", "学习"]).first()
    both = long | short
    assert one["total"] == len(both) and one["by_group"] == {"note": sum(i % 2 == 0 for i in both), "book": sum(i % 2 for i in both)}
    titles = " ".join(t for i, t, _ in sorted(r for r in rows if r[0] in both)[:30] if t)
    assert list(one["related"]) == [w for w in plain_keywords(titles, 20) if not any(w in t or t in w for t in ("alpha", "学习"))][:5]


def test_titles_inside_texts(spark, indexed):
    rows, df, index = indexed
    names = ["alpha", "Alphabet", "学习模型", "aaaa", "nowhere at all", "机器学习机器学习", "ab"]
    titles = spark.createDataFrame(list(enumerate(names)), "title_id long, title string")
    got = {tuple(r) for r in postings.containing(index["grams"], df, titles).collect()}
    assert got == {(i, k) for i, _, c in rows for k, t in enumerate(names) if len(t) > 2 and t in (c or "")}
    assert retrieval.every_match(index["grams"], df, "alphabet", ["title"]).count() == sum("alphabet" in ((t or "") + "\n" + (c or "")).lower() for _, t, c in rows)
    both = retrieval.refined(index["grams"], df, ["alpha", "模型，"], ["学习", "x"]).collect()
    has = lambda r, t: any(t in (x or "").lower() for x in r[1:])
    assert {r["id"] for r in both} == {r[0] for r in rows if has(r, "alpha") and has(r, "模型，") and (has(r, "学习") or has(r, "x"))}


def test_runs_at_once_equal_tokens():
    import random

    rng, runs = random.Random(1), postings.Runs()
    letters = [*"ab1.,\x00é \n\t\x1c\u3000\xa0", "中", "文", "豈", "䶿", "\U00020000", "页", "abcd"]
    for _ in range(200):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 6))]
        number, doc, place, terms = runs.places(texts)
        got = [(terms[n], d, p) for n, d, p in zip(number.tolist(), doc.tolist(), place.tolist(), strict=True)]
        assert sorted(got) == sorted((s, i, at) for i, t in enumerate(texts) for s, at in runs.tokens(t)) and terms == sorted(terms)


def test_index_is_written_without_shuffle(spark, tmp_path):
    """Rows go to their folders where they are made: one file a task and folder, each in its part's order of terms."""
    df = spark.range(400).selectExpr("id", "concat('alpha beta ', id) AS title", "repeat(concat('gamma ', id, ' '), 20) AS content")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index write", "")
    postings.Index(spark, str(tmp_path / "ix"), ("title", "content")).write(df, str(tmp_path / "ix/postings/generation=0"))
    stages = {s for j in tracker.getJobIdsForGroup("index write") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1  # rows are made and written in one


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_containment_either_way(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(postings, "BROADCAST_BYTES", most)
    df = spark.createDataFrame([(i, f"doc {i}", f"some text {i % 7} of red, {'blue sky' if i % 3 else 'green sea'}") for i in range(40)], "id long, title string, content string")
    titles = spark.createDataFrame([(1, "blue sky"), (2, "text 3 of"), (3, "nowhere"), (4, "green sea"), (4, "green sea"), (4, "red, green")], "title_id long, title string")
    index = postings.Index(spark, str(tmp_path / "ix"), ("title", "content")).build(df)
    got = sorted(map(tuple, postings.containing(index, df, titles).collect()))
    assert got == sorted((r.id, t) for r in df.collect() for t, x in {(1, "blue sky"), (2, "text 3 of"), (4, "green sea"), (4, "red, green")} if x in r.content)
