"""Merkle manifest, block-norm clustering and Order MinHash against plain loops; odd inputs, hot keys, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import block_clusters, merkle_manifest, order_minhash
from corpusloom.llm.common import Scratch, placed

DOCS = "doc_id long, source string, lang string, n_chars long, text string, subroot string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def documents(n, seed=1):
    """A hot source, a null source, a source of one row, nulls in every column, a repeated row, a long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{rng.randint(0, 20)}" if i != 7 else "lonely é"
        text = None if i % 13 == 0 else "" if i % 17 == 0 else " ".join(rng.choices(["Ab", "cD", "été", "数据", "x"], k=rng.randint(1, 30)))
        rows.append((i * 7919 % 100_003, source, None if i % 5 == 0 else "en", None if i % 7 == 0 else i, text, "clash"))
    rows += [rows[3], rows[3], (None, "hot", None, None, None, None), (9_999_999, "long", "en", 0, "Word " * 60_000, "c")]
    return rows


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the lower-cased text), by recursion over lists."""
    item = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r: H(*map(item, r[:5]))

    def tree(nodes):
        """root and, by node, the siblings on the way: [(before, after), ...]."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for leaf, i in enumerate(at):
                lo = i - i % 16
                paths[leaf].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
            level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
            at = [i // 16 for i in at]
        return level[0], paths

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, own = [], {}
    for s in order:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        root, paths = tree([digest(r) for r in ordered])
        subs.append(root)
        own[s] = list(zip(ordered, paths, strict=True))
    root, tops = tree(subs)
    out = []
    for s, sub, top in zip(order, subs, tops, strict=True):
        for r, path in own[s]:
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = None if r[4] is None else re.sub("[A-Z]", lambda m: m.group().lower(), r[4])
            acc = digest((*r[:4], lower)) if hit else digest(r)
            for b, a in path + top:
                acc = H(b, acc, a)
            out.append((r[0], digest(r), sub, root, H(*[b + a for b, a in path + top]), acc, acc == root))
    return out


@pytest.mark.parametrize("n", [1, 16, 17, 900])
def test_manifest_equals_recursion(spark, tmp_path, n):
    rows = documents(n) if n > 100 else [(i, "one", "en", 1, f"T{i}", "c") for i in range(n)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle_manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(plain_manifest(rows), key=repr)
    assert got == want
    assert n < 100 or {True, False} == {r[-1] for r in got}


def test_manifest_of_no_rows_and_other_columns(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle_manifest.manifest(df).count() == 0
    one = spark.createDataFrame([(5, "g", "x")], "k int, g string, proof string")
    row = merkle_manifest.manifest(one, "k", "g", ("k", "proof")).first()
    assert row["leaf"] == row["root"] == row["subroot"] == H("1:5", "1:x") and row["proof"] == []


def test_placed_spreads_one_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i * 37 % 1000) for i in range(1000)], "g string, x int").repartition(4)
    got = placed(Scratch(spark, "test"), df, [F.col("g"), F.col("x").desc()], ("g",)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(len(rows))) and {r["total"] for r in rows} == {len(rows)}
        assert [r["x"] for r in rows] == sorted((r["x"] for r in rows), reverse=True)


def plain_clusters(rows, k=40, rounds=5):
    """vec_id -> cluster, distance; and the centroids, with Python's integers."""
    fine = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**19 for x in v)}
    centres = [fine[i] for i in sorted(fine, key=lambda i: H(f"2:{i}"))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        by = defaultdict(list)
        for v in fine.values():
            by[near(v)[1]].append(v)
        for j, vs in by.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    return {i: near(v)[::-1] for i, v in fine.items()}, centres


def test_clusters_equal_integers(spark, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (9, 64))
    rows = [(i, (middle[i % 9] + rng.normal(0, 0.3 if i % 2 else 2.0, 64)).astype(np.float32).tolist(), i) for i in range(250)]
    rows += [(1000 + i, [0.5] * 64, 0) for i in range(120)]  # one vector many times
    odd = [None, [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, [], [600_000.0] * 64]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(2100, [0.0] * 64, 0), (2101, [500_000.0] * 64, 0), (2102, [-500_000.0] * 64, 0), (None, [1.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = block_clusters.op11_block_clusters(spark, str(tmp_path)).collect()
    want, centres = plain_clusters([r[:2] for r in rows])
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == want and len(got) == len(want)
    inertia = Counter()
    for c, d in want.values():
        inertia[c] += d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == H(",".join(map(str, centres[r["cluster"]])))


def test_clusters_of_few_and_no_vectors(spark):
    out, centres = block_clusters.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and len(centres) == 0 and out.columns == ["vec_id", "cluster", "distance"]
    out, centres = block_clusters.clusters(spark.createDataFrame([(1, [1.0] * 64), (1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<double>"))
    assert len(centres) == 3 and sorted(r["distance"] for r in out.collect()) == [0, 0, 0]


def test_screening_is_exact_and_prunes():
    rng = np.random.default_rng(0)
    spread = rng.normal(0, 1, (12, 64)) * rng.uniform(0, 4, (12, 1)) * np.repeat(rng.uniform(0, 2, (12, 8)), 8, 1)
    x = np.floor(256 * (spread[rng.integers(0, 12, 600)] + rng.normal(0, 0.2, (600, 64)))).astype(np.int64)
    centres = np.floor(256 * spread).astype(np.int64)
    near, best, taken = block_clusters.screened(x, block_clusters.block_vectors(x), centres)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (best == d.min(1)).all() and taken < 0.5 * d.size
    same = np.zeros((5, 64), np.int64)
    assert block_clusters.screened(same, block_clusters.block_vectors(same), np.zeros((3, 64), np.int64))[0].tolist() == [0] * 5
    low = (np.square(block_clusters.block_vectors(x)).sum(1)[:, None] + np.square(block_clusters.block_vectors(centres)).sum(1)[None] - 2 * block_clusters.block_vectors(x) @ block_clusters.block_vectors(centres).T)
    assert (low <= d * (1 + 1e-9) + 1).all()


def plain_print(text, k=3, take=2):
    words = re.findall(r"[぀-ヿ㐀-鿿]|[^\x20\x09-\x0D぀-ヿ㐀-鿿]+", text or "")
    codes = [zlib.crc32(w.encode()) for w in words]
    rows = [codes[i : i + k] for i in range(len(codes) - k + 1)] if len(codes) >= k else [codes] if codes else []
    seen, bins = Counter(), defaultdict(list)
    for i, row in enumerate(rows):
        g = sum(c * f for c, f in zip(row, order_minhash.FACTORS, strict=False)) % (2**31 - 1)
        h = (g + seen[g] * 1_500_450_271) % (2**31 - 1)
        seen[g] += 1
        bins[h >> 25].append((h, i))
    out = []
    for b in sorted(bins):
        chosen = sorted(sorted(bins[b])[:take], key=lambda x: x[1])
        out.append(f"{b:02}" + hashlib.md5(",".join(str(h % 2**25) for h, _ in chosen).encode()).hexdigest()[:8])
    return out


def plain_likeness(a, b):
    used = {x[:2] for x in a} | {x[:2] for x in b}
    return len(set(a) & set(b)) / len(used) if used else 1.0


TEXTS = [None, "", " \t\n", "one", "one two", "a b c", "a b c a b c a b c", "数据数据数据の", "été déjà vu " * 40, "x" * 5000, "A股票 test", "😀 b c d", "word " * 20_000, "a\x1fb c\xa0d e"]


def test_prints_equal_loop(spark, tmp_path):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 400))) for _ in range(60)]
    rows = [(i * 31 % 1009, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, entries string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in order_minhash.op13_order_minhash(spark, str(tmp_path)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (i, t, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after, r = t or "", after or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, b = map(plain_print, (t, edited, after))
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), "".join(a), "".join(e))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(plain_likeness(a, e)) and r["near_next"] == pytest.approx(plain_likeness(a, b))


def test_prints_repeat_nulls_and_order(spark):
    rows = [(1, "same text here now", "en")] * 200 + [(None, "null key", "en"), (None, None, None), (2, None, "en")]
    out = order_minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string, next_text string"))
    got = out.collect()
    assert len(got) == 203 and Counter(r["next_text"] for r in got) == Counter(r[1] or "" for r in rows)
    assert [r["next_text"] for r in got if r["doc_id"] == 2] == ["same text here now"]
    assert order_minhash.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert order_minhash.with_next(spark.createDataFrame([(4, "alone")], "doc_id long, text string")).first()["next_text"] == "alone"
    assert order_minhash.fingerprints(spark.createDataFrame([(1, None, "x")], "a int, text string, fingerprint string")).first()["fingerprint"] == ""


def test_prints_see_moved_passages():
    """Equal sets of k-mers in another order are unlike, and likeness falls with the number of edits."""
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(900)]
    base = plain_print(" ".join(words))
    moved = words[450:] + words[:450]
    assert 0.2 < plain_likeness(base, plain_print(" ".join(moved))) < 0.8
    likes = []
    for edits in (0, 3, 12, 60, 300):
        other = list(words)
        for i in rng.sample(range(900), edits):
            other[i] = "changed"
        likes.append(plain_likeness(base, plain_print(" ".join(other))))
    assert likes[0] == 1 and likes == sorted(likes, reverse=True) and likes[-1] < 0.2
