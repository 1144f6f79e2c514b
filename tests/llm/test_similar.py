"""Near-duplicates, components and the fixity audit against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from depthkit.llm import fixity, lsh, minhash
from depthkit.llm.base import text_slices
from depthkit.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    links += [(7, 7), (3, 4), (4, 3), (None, 5)]
    real = [x for x in links if None not in x]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for x in real for n in x}, real)
    assert got == {n: r for n, r in want.items() if any(n in x and x[0] != x[1] for x in real)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return Counter([tuple(words)] if 0 < len(words) < 5 else zip(*(words[i:] for i in range(5))))


def classes_brute(rows, threshold=0.8, rare=minhash.RARE):
    sets = [shingles(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    idf = {s: math.log1p(1 / max(n / len(rows), rare)) / math.log1p(1 / rare) for s, n in df.items()}
    weight = [{s: (1 + math.log(n)) * idf[s] for s, n in x.items()} for x in sets]
    links = []
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            keys = set(weight[i]) | set(weight[j])
            low = sum(min(weight[i].get(k, 0), weight[j].get(k, 0)) for k in keys)
            if keys and low / sum(max(weight[i].get(k, 0), weight[j].get(k, 0)) for k in keys) >= threshold:
                links.append((a, rows[j][0]))
    return roots([r[0] for r in rows], links)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(40):
        base = [word() for _ in range(rng.randint(40, 120))] + (passage if g % 3 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    base = [word() for _ in range(150)]  # a large group of near copies around one text
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += ["one two three", "One  two three", "the same line\n" * 50, "the same line\n" * 50 + "x", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [16, 512])
def test_minhash_classes_equal_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class_id int").repartition(4)
    out = minhash.near_duplicates(df, block=block).collect()
    assert {r.doc_id: r.class_id for r in out} == classes_brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_minhash_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, " \n"), (6, "other words entirely here now then"), (6, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (6, 1, False)], key=str)
    left = minhash.keep_first(df)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, None, 3, 4, 5, 6], key=str) and left.columns == df.columns
    assert [r.text for r in left.collect() if r.doc_id == 6] == ["other words entirely here now then"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_first(df.limit(0)).count() == 0


def test_every_text_of_a_repeated_id_keeps_its_links(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [[word() for _ in range(60)] for _ in range(4)]
    near = [" ".join(b[:59] + [word()]) for b in base]
    rows = [(7, " ".join(b)) for b in base] + [(10 + i, t) for i, t in enumerate(near)]  # four texts with one id, and a near copy of each
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(df, fold_copies=True).collect()]
    assert sorted(got) == sorted([(7, 7, True)] * 4 + [(10 + i, 7, False) for i in range(4)])
    assert sorted(r.text for r in minhash.keep_first(df, fold_copies=True).collect()) == sorted(t for i, t in rows if i == 7)


def test_texts_with_colliding_polynomials_are_not_copies(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, " ".join(word)), (4, " ".join(other)), (5, word)]
    got = {r.doc_id: (r.class_id, r.n_copies) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (3, 1), 5: (1, 2)}  # 3 and 4 have nearly the same shingles


def test_minhash_classes_of_distinct_texts_equal_brute_force(spark):
    rows, first = corpus(), {}
    for i, t in rows:
        first.setdefault(tuple(t.lower().split()), (i, t))
    want = classes_brute(list(first.values()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block=16, fold_copies=True).collect()}
    assert got == {i: want[first[tuple(t.lower().split())][0]] for i, t in rows}
    assert got != classes_brute(rows)


def test_copies_do_not_change_similarity(spark):
    """A third of the rows are copies of one text: near copies of it (0.81 to 0.85) stay linked."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    hot = [word() for _ in range(100)]
    near = [hot[:k] + [word() for _ in range(run)] + hot[k + run:] for k, run in ((10, 4), (40, 5), (70, 6))]
    for x in near:
        a, b = shingles(" ".join(hot)), shingles(" ".join(x))
        assert 0.8 < sum((a & b).values()) / sum((a | b).values()) < 0.87
    texts = [" ".join(hot)] * 80 + [" ".join(x) for x in near] + [" ".join(word() for _ in range(60)) for _ in range(157)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    out = {r.doc_id: r for r in minhash.near_duplicates(df, fold_copies=True).collect()}
    assert all(out[i].class_id == 0 for i in range(83)) and all(out[i].class_id == i for i in range(83, 240))
    assert out[5].n_copies == 80 and minhash.keep_first(df, fold_copies=True).count() == 158
    boiler = " all of these words are here"
    rows = [" ".join(hot) + boiler] * 300 + [" ".join(word() for _ in range(30)) + (boiler if i % 5 == 0 else "") for i in range(200)] + ["", None]
    for sample in (minhash.SAMPLE_TEXTS, 150):
        keys, freq, n = minhash.common_shingles_of_distinct(
            spark.createDataFrame([(r,) for r in rows], "text string").repartition(5), sample=sample)
        assert n == 201 and freq.tolist() == [41, 41]


def test_common_shingles_are_counted_exactly(spark):
    rng = random.Random(2)
    rows = [" ".join(rng.choices("abcdefghijklmnop", k=30)) + (" all of these words are here" if i % 3 == 0 else "") for i in range(400)]
    keys, freq, n = minhash.common_shingles(spark.createDataFrame([(r,) for r in rows], "text string").repartition(7))
    want = Counter()
    for _, _, data, offs in text_slices(pa.array(rows)):
        want.update(minhash.features(data, offs).key.tolist())
    assert n == 400 and dict(zip(keys.tolist(), freq.tolist())) == {k: c for k, c in want.items() if c > minhash.RARE * n}


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    key = rng.integers(1 << 48, size=300, dtype=np.uint64)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    b[:220] = a[:220]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = minhash.Sampler(3000)
    x, y = (s.draw(key[w > 0], w[w > 0].astype(float), np.array([0]))[0] for w in (a, b))
    assert abs((x == y).mean() - want) < 0.04


# ---- vectors ---------------------------------------------------------------------------------
def vectors(n=400, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(12):
        members = rng.integers(0, n, 12)
        x[members] = x[members[0]] + rng.normal(size=(12, dim)) * rng.uniform(0.02, 0.2)
    x[7] = x[9] = x[11]
    return x.astype(np.float32)


def links_brute(ids, x, threshold=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    return dict(zip(ids, s.sum(1).tolist())), roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(s))])


@pytest.mark.parametrize("block", [4, 2048])
def test_vector_links_equal_brute_force(spark, block):
    x = vectors()
    ids = list(range(1000, 1400))
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n_links string").repartition(3)
    out = lsh.near_duplicates(df, block=block).collect()
    n, comp = links_brute(ids, x)
    assert {r.vec_id: r.n_links for r in out} == n and {r.vec_id: r.component_id for r in out} == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95 ** 2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    a, b = lsh.cells(x), lsh.cells(y)
    hit = np.zeros(len(x), bool)
    for j in range(a.shape[1]):
        hit |= (a[:, j][:, None] == b).any(1)
    assert hit.mean() > 0.99


def test_fast_transform_is_a_rotation():
    x = np.eye(32)
    h = lsh.hadamard(x.copy())
    assert np.allclose(h @ h.T, np.eye(32)) and np.allclose(np.abs(h), 1 / math.sqrt(32))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]),
            (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in lsh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (10, 3, 1), (None, 0, None)] + [(i, 0, i) for i in range(3, 10)], key=str)
    assert lsh.near_duplicates(df.limit(0)).count() == 0


# ---- fixity ------------------------------------------------------------------------------------
def test_audit_locates_every_difference(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(3000)] + [(5, "u5", "body 5"), (None, "n", None), (-3, "neg", "x"), (10 ** 9, "far", "y")]
    other = [r for r in rows if r[0] != 77]
    other[10], other[1999] = (10, "u10", "changed"), (2000, "u2000", None)
    other += [(20, "u20", "body 20"), (None, "n2", None), (4000, "new", "z")]
    a, b = (spark.createDataFrame(x, "at long, url string, sha string") for x in (rows, other))
    got = Counter((r.at, r.n_primary, r.n_replica) for r in fixity.audit(a, b, "at", ["at", "url", "sha"]).collect())
    assert got == Counter([(77, 1, 0), (10, 1, 0), (10, 0, 1), (2000, 1, 0), (2000, 0, 1), (20, 1, 2), (None, 0, 1), (4000, 0, 1)])
    assert fixity.audit(a, a.repartition(7), "at", ["at", "url", "sha"]).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0), "at", ["at"]).count() == 0
    assert fixity.audit(a, a.limit(0), "at", ["at", "url", "sha"]).count() == len(set(rows))


def test_only_mismatching_branches_are_read(spark):
    recs = fixity.records(spark.range(5000).selectExpr("id as at", "cast(id as string) as b"), "at", ["at", "b"])
    changed = fixity.records(spark.range(5000).selectExpr("id as at", "cast(if(id = 4321, 0, id) as string) as b"), "at", ["at", "b"])
    a, b = fixity.tree(recs, 4, "t"), fixity.tree(changed, 4, "t")
    bad = None
    for level in range(4, -1, -1):
        bad = fixity._mismatch(a[level], b[level], bad)
        assert [r.k for r in bad.collect()] == [4321 // fixity.FAN ** level]


def test_common_shingles_are_proposed_by_all_texts(spark):
    """A sample of 20 of 900 texts misses or adds shingles near the limit; counting all texts does not, however copies lie."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    marks = [" ".join(word() for _ in range(5)) for _ in range(12)]
    base = [" ".join(word() for _ in range(12)) + "".join(f" {m}" for k, m in enumerate(marks) if i % (8 + k // 4) == 0) for i in range(900)]
    rows = base + [base[i % 40] for i in range(1500)]
    want = Counter()
    for _, _, data, offs in text_slices(pa.array(base)):
        want.update(minhash.features(data, offs).key.tolist())
    want = {k: c for k, c in want.items() if c > minhash.RARE * 900}
    for parts in (1, 9):
        keys, freq, n = minhash.common_shingles_of_distinct(spark.createDataFrame([(r,) for r in rows], "text string").repartition(parts), sample=20)
        assert n == 900 and want and dict(zip(keys.tolist(), freq.tolist())) == want


def test_weights_are_the_formula_of_every_shingle(spark):
    """A shingle in up to a tenth of the texts has idf 1 by the formula, so weights need the frequencies above that only."""
    rng = random.Random(8)
    rows = [" ".join(["the same six words of all", *(["half of the texts have this"] if i % 2 else []), *(["rare words in two texts here"] if i < 2 else []),
                      *(f"w{rng.randrange(10 ** 6)}" for _ in range(8))]) for i in range(40)]
    raw = [t.encode() for t in rows]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    f = minhash.features(data, offs)
    key, df = np.unique(f.key, return_counts=True)
    idf = dict(zip(key.tolist(), np.log1p(1 / np.maximum(df / len(rows), minhash.RARE)) / np.log1p(1 / minhash.RARE)))
    want = [(1 + math.log(t)) * idf[k] for k, t in zip(f.key.tolist(), f.tf.tolist())]
    texts = spark.createDataFrame([(r,) for r in rows], "text string").repartition(5)
    for common in (minhash.common_shingles(texts), minhash.common_shingles_of_distinct(texts)):
        assert np.allclose(minhash.weights(f.key, f.tf, common), want, rtol=1e-12)
    assert len({round(v, 9) for v in idf.values()}) == 3
