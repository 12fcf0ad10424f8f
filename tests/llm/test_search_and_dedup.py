"""Near-duplicates, line dedup, nearest neighbours and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import dart_minhash, darts, line_dedup, spotsigs, vptree

from .brute import kept_lines, near_classes

np.seterr(over="ignore")


def crowd(seed, groups=3, each=40):
    """Groups of near copies around a text that few of them equal, so that many are near the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 12])):
                i = rng.randrange(len(t))
                t[i] = rng.choice([t[i] + ",", t[i].upper(), rng.choice(words[:20]), "x"])
            texts.append(" ".join(t[: rng.randrange(100, 150)] if rng.random() < 0.3 else t))
    texts += texts[:15] + ["", "", "  ", "a b", "a b", "a b c", None] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates(spark, seed):
    rows = crowd(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, bands int")
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()} == near_classes(rows)


def test_sketches_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.8):
        same = []
        for _ in range(20):
            n = 400
            both = int(2 * n * share / (1 + share))
            ids = darts.mix(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
            a, b = ids[:n], ids[n - both : 2 * n - both]
            s = darts.sketch(np.r_[a, b], np.ones(2 * n), np.repeat([0, 1], n), 2, 96)
            same.append((s[0] == s[1]).mean())
        assert abs(np.mean(same) - share) < 0.03
    # real weights: the lesser over the greater ones
    for scale in (0.05, 1.0, 9.0):
        same, want = [], []
        for _ in range(20):
            ids = darts.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
            x, y = rng.uniform(0.4, 3, 300) * scale, rng.uniform(0.4, 3, 300) * scale
            s = darts.sketch(np.r_[ids, ids], np.r_[x, y], np.repeat([0, 1], 300), 2, 96)
            same.append((s[0] == s[1]).mean()), want.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
        assert abs(np.mean(same) - np.mean(want)) < 0.03
    with pytest.raises(ValueError):
        darts.sketch(ids, np.zeros(300), np.zeros(300, int), 1, 96)
    # repeated shingles count as often as both sides have them
    a, b = darts.shingle_cells("a b c d e " * 4), darts.shingle_cells("a b c d e " * 3)
    assert len(a) == 16 and len(b) == 11 and darts.similarity(a, b) == 11 / 16


def test_keep_one(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "a b"), (3, "a b"), (9, "other text"), (None, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in dart_minhash.keep_one(df).collect() if r.doc_id is not None) == [3, 9]
    assert dart_minhash.keep_one(df).where("doc_id is null").count() == 2


@pytest.mark.parametrize("batches,fanout", [(1, 4), (4, 2), (5, 2)])
def test_lines(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["Foo", " foo\t", "FOO\x0b", "bar", "", "  ", "Ébar", "ébar", "long " * 50]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i}", "x" * rng.randrange(4)]) for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(90, None), (91, ""), (92, "\n\n"), (93, "foo\r\nbar"), (94, "foo\n" * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_lines int")
    out = line_dedup.drop_frequent_lines(df, 10, batches=batches, fanout=fanout).collect()
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out}
    want = {i: (n, n - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()) for i, (n, stay) in kept_lines(rows, 10).items()}
    assert got == want and all(r.row.n_lines == 1 for r in out)


def test_runs_by_batch(spark):
    """Batches one after another: each drops what the runs have settled, takes over their counts, and levels are compacted."""
    runs, count = line_dedup.LineRuns(spark, fanout=2, min_docs=3), {}
    for b in range(7):
        mine = {f"line {b}", f"line {b // 2}", f"line {b + 1}", "hot"}
        line_dedup.add_documents(runs, spark.createDataFrame([("\n".join(sorted(mine)),)], "text string"))
        for k in mine:
            count[k] = count.get(k, 0) + 1
        hashes = {k: spark.range(1).select(*line_dedup.hashed(F.lit(k), "h1", "h2")).first() for k in count}
        assert {(r.h1, r.h2) for r in runs.frequent().collect()} == {tuple(hashes[k]) for k, n in count.items() if n >= 3}
        assert runs.frequent().count() == sum(n >= 3 for n in count.values())
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.runs()) == 3  # seven batches: levels 0, 1 and 2
    runs.drop()


def test_runs_are_met_without_shuffle_or_sort(spark):
    runs = line_dedup.LineRuns(spark, fanout=3, min_docs=2)
    for b in range(2):
        line_dedup.add_documents(runs, spark.createDataFrame([(f"line {i}",) for i in range(b, 200)], "text string"))
    with line_dedup.setting(spark, **line_dedup.SORTED):
        met = runs.met(runs.runs()[1])
        plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "LeftAnti" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.drop()


def brute_nearest(ids, vectors, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], d[j]) for j in order]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=(500, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0), rng.normal(size=(200, 8)) * 0.01]).astype(np.float32)
    ids = rng.permutation(len(vectors)) * 5
    rows = [(int(i), [float(x) for x in v], 1) for i, v in zip(ids, vectors, strict=True)]
    bad = [(None, [1.0] * 8, 1), (100_000, None, 1), (100_100, [0.0] * 8, 1), (100_200, [float("nan")] * 8, 1), (100_300, [None] + [1.0] * 7, 1), (100_400, [float("inf")] + [1.0] * 7, 1), (100_500, [], 1), rows[3]]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, v int")
    index = vptree.build_index(df, shard_rows=300)
    want = brute_nearest(ids, vectors.astype(float))
    got = {}
    for r in vptree.search(index, df.where("vec_id % 100 = 0"), block_queries=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    loose = vptree.search(index, df.where("vec_id % 100 = 0"), factor=1.5).collect()
    hits = sum((r.vec_id in {v for v, _ in want[r.query_id]}) for r in loose)
    assert hits >= 0.9 * sum(map(len, want.values()))


def spots(text):
    words = [w for w in __import__("regex").split(r"[^\p{L}\p{M}\p{N}]+", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i + 1 :] if x not in anchors][:2]
            if chain:
                out.add((w, *chain))
    return out or {("words", *words) if words else ("text", text)}


def visited(vectors, asked, factor, shard_rows, k=10):
    """(distances computed for a query, recall) of the whole search, without Spark."""
    n = len(vectors)
    leaves = -(-n // shard_rows)
    top = vptree.Top.fit(vectors[: max(64, n // 4)], (leaves - 1).bit_length())
    leaf, trees = top.route(vectors), {}
    for x in np.unique(leaf):
        trees[x] = vptree.Tree.build(np.flatnonzero(leaf == x), vectors[leaf == x])
        top.lo[x], top.hi[x] = top.ranges(x, trees[x].vectors)
    q, home = vectors[asked], leaf[asked]
    found = [[] for _ in asked]

    def look(x, rows, within):
        d, ids = trees[x].search(q[rows], asked[rows], k, factor, within)
        for r, a, b in zip(rows, d, ids, strict=True):
            found[r] += [(u, v) for u, v in zip(a, b, strict=True) if np.isfinite(u)]

    for x in trees:
        rows = np.flatnonzero(home == x)
        look(x, rows, np.full(len(rows), np.inf))
    nearest = np.array([sorted(f)[k - 1][0] if len(f) >= k else np.inf for f in found])
    for x, rows in top.others(q, home, nearest, factor):
        look(x, rows, nearest[rows])
    right = 0
    for r, i in enumerate(asked):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        right += len({v for _, v in sorted(found[r])[:k]} & set(np.lexsort((np.arange(n), d))[:k]))
    work = sum(t.work for t in trees.values()) + len(asked) * (len(top.paths) - 1)
    return work / len(asked), right / (k * len(asked))


def test_clustered_vectors_are_pruned():
    """With five times the rows, a query computes far from five times the distances, and finds all."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32)) * 3
    share = []
    for n in (4000, 20_000):
        vectors = centres[rng.integers(60, size=n)] + rng.normal(size=(n, 32)) * 0.3
        work, recall = visited(vectors, np.arange(0, n, 100), 1.0, 512)
        assert recall == 1.0
        share.append(work / n)
    assert share[0] < 0.5 and share[1] < 0.3
    assert visited(vectors, np.arange(0, n, 100), 2.0, 512)[1] >= 0.9


def test_fingerprints(spark):
    rng = random.Random(4)
    words = ["the", "of", "la", "y", "stone", "river", "moss", "fern", "Árbol", "x1"]
    rows = [(rng.randrange(10**6), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [(-5, None), (10**7, ""), (10**7 + 1, "!!!"), (10**7 + 2, "moss fern"), (10**7 + 3, "moss fern"), (10**7 + 4, "ab")]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, sig int")
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    old, spotsigs.BUCKET_ROWS = spotsigs.BUCKET_ROWS, 20
    try:
        got = {r.doc_id: r for r in spotsigs.compare_edited(df).collect()}
    finally:
        spotsigs.BUCKET_ROWS = old
    assert len(got) == len(rows)
    jac = lambda a, b: len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(jac(spots(t), spots(edited))) and got[i].near_next == pytest.approx(jac(spots(t), spots(nxt)))
    assert got[10**7 + 2].fingerprint == got[10**7 + 3].fingerprint and got[10**7 + 3].near_next == 1.0


@pytest.mark.parametrize("start", ["moss", "the", "!"])
def test_different_texts_have_different_fingerprints(spark, start):
    """Among so many texts some agree in a hash of 32 bits."""
    n = 300_000
    text = F.translate(F.col("id").cast("string"), "0123456789", "!?;:-+*/()") if start == "!" else F.concat(F.lit(f"{start} w"), F.col("id").cast("string"))
    sigs = spotsigs.with_fingerprint(spark.range(n).select(text.alias("text")), "text", "sig")
    assert sigs.select("sig").distinct().count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_documents_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    anchors, words = ["the", "of", "is", "der", "la"], [f"w{i}" for i in range(80)]
    rows = []
    for g in range(6):
        base = [rng.choice(anchors) if rng.random() < 0.5 else rng.choice(words) for _ in range(120)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t[: rng.randrange(90, 120)] if rng.random() < 0.3 else t))
    rows += rows[:10] + [None, "", "  ", "no anchor here", "no anchor here"]
    rows = [(5 * i, t) for i, t in enumerate(rows)] + [(None, "the w1 w2")]
    got = {r.doc_id: r.class_id for r in spotsigs.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: spots(t or "") for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in ids} | {None: None}


def test_pruned_pairs(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(9))), (list(range(10)), [1, 2]), (list(range(10)), list(range(5, 15)))], "a array<int>, b array<int>")
    assert [round(r.likeness, 6) for r in spotsigs.similar_pairs(df, "a", "b").collect()] == [0.9]
    assert df.select(F.sum(spotsigs.jaccard(F.col("a"), F.col("b")))).first()[0] == pytest.approx(0.9 + 0.2 + 1 / 3)
