"""Filter audit, lexical search and ball-tree search against brute force; odd rows, ties, empty tables."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthkit.llm import ball_search, filter_audit, lexical

DOCS = "doc_id long, text string, lang string, extra string, part string"
LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- op 11


def failing(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return "".join(x for x, bad in [
        ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
        ("D", re.search("[#$%&*|]", text)), ("E", smaller)] if bad)


def audit_brute(docs, labels):
    rows = []
    for d, text, lang in docs:
        t = text or ""
        smaller = d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs)
        said = [x for x in labels if x[0] is not None and x[0] == d]
        rows.append((lang or "", failing(t, smaller), any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.sample(words, 250))
    rows = [(i, long if i % 3 == 0 else " ".join(rng.choices(words[:rng.choice([3, 60, 400])], k=rng.choice([5, 199, 200, 260]))), rng.choice(["en", "de", None]))
            for i in range(60)]
    rows += [(60, None, "en"), (61, "", "en"), (62, "A B", "fr"), (62, "A B", "fr"), (62, "other # text", "de"), (63, "x y　z $", ""), (None, "A B", "fr"), (None, None, None),
             (64, long.upper(), "en"), (65, "same " * 300, "en"), (66, "Ä" * 40 + "A", "de"), (67, long + " |", "en"), (3, long, "en")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 70, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def audit(spark, rows, labels, **names):
    docs = spark.createDataFrame([(*r, "x", "clash") for r in rows], DOCS).withColumnsRenamed(names)
    return filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), **{k: v for k, v in [("doc_id", names.get("doc_id", "doc_id")), ("text", names.get("text", "text"))]})


def test_filter_audit(spark, monkeypatch):
    rows, labels = texts()
    want = audit_brute(rows, labels)
    for hot in (1000, 10):  # with and without salted texts
        monkeypatch.setattr(filter_audit, "HOT", hot)
        got = audit(spark, rows, labels).collect()
        assert len(got) == len(want) == 600 * 4
        for r in got:
            assert want[r.part, r.filter_order, r.step] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley), (r, want[r.part, r.filter_order, r.step])
    assert audit(spark, [], labels).count() == 0


def test_hot_texts_are_salted(spark):
    docs = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.concat(F.lit("text "), (F.col("id") % 5000).cast("string"))).alias("text"))
    docs = docs.withColumn("hash", F.unhex(F.sha2("text", 256)))
    got = {r.id for r in filter_audit.repeats(docs).select("id").collect()}
    first = {}
    for i in range(20_000):
        first.setdefault("c" if i % 3 == 0 else i % 5000, i)
    assert got == {i for i in range(20_000) if first["c" if i % 3 == 0 else i % 5000] != i}


# ---------------------------------------------------------------- op 12


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def search_brute(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(full), sum(sum(b.values()) for _, b in full)
    df = Counter(t for _, b in full for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, b in full:
            n = sum(b.values())
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in q.items() if b[t])
            if d is not None and score > 0:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def search(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 7, "clash") for r in docs], "doc_id long, text string, n long, bag string")
    return lexical.search(d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int"), **more)


def corpus():
    rng = random.Random(9)
    words = ["the", "The", "of", "café", "CAFÉ", "日本語", "x1", "a-b", "c_d", "e.f", " ", *[f"w{i}" for i in range(80)]]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300 + i, docs[3][1].replace("the", "THE") + " zzz") for i in range(30)]  # classes of copies, and of the same length and bag
    docs += [(400, None), (401, ""), (402, "-- ! --"), (403, "only others"), (5, docs[7][1]), (5, docs[5][1]), (None, docs[9][1]), (404, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unknown"), (3, "w5 w6"), (None, "the of"), (23, docs[3][1]), (24, "w1 w1 w1"), (25, "a-b c_d")]
    rng.shuffle(docs)
    return docs, items


def test_lexical_search(spark):
    docs, items = corpus()
    want = search_brute(docs, items)
    for chars in (4_000_000, 100):  # one block of items, and several
        got = sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in search(spark, docs, items, block_chars=chars).collect())
        assert got == want
    assert any(a[3] == b[3] for a, b in zip(want, want[1:])) and {r[0] for r in want}.isdisjoint({20, 21, 22})


def test_lexical_search_without_rows(spark):
    docs, items = corpus()
    assert search(spark, [], items).count() == 0 and search(spark, docs, []).count() == 0
    assert search(spark, [(1, None), (2, " ")], items).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_vocabulary_tells_colliding_terms_apart():
    a = thue_morse(1024).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    known = lexical.Vocabulary([b"x", a, b, b"yy"])
    data = np.frombuffer(b + a + b"yyz", np.uint8)
    s, e = np.array([0, 1024, 2048, 2050]), np.array([1024, 2048, 2050, 2051])
    assert known.find(data, s, e).tolist() == [2, 1, 3, -1]


# ---------------------------------------------------------------- op 13


def top_brute(rows, k=5, every=50):
    v = []
    for i, (d, x) in enumerate(rows):
        if d is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, d, [math.floor(256 * c) for c in x]))
    out = []
    for i, d, q in v:
        if d % every == 0:
            score = lambda x: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(q, x))))
            found = sorted((-score(x), e) for j, e, x in v if j != i and len(x) == len(q))[:k]
            out += [(d, r + 1, e, -s) for r, (s, e) in enumerate(found)]
    return sorted(out)


def vectors(dim=8, n=700, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = (centre[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32).astype(float)
    x[::3] = x[0]  # a third of the rows are one vector
    return [(i, r.tolist()) for i, r in enumerate(x)]


def top(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, shard int")
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in ball_search.top_k(df, **more).collect())


@pytest.mark.parametrize("shard,leaf,block", [(16384, 64, 65536), (50, 4, 3), (1, 1, 1000)])
def test_ball_tree(spark, shard, leaf, block):
    rows = vectors(n=700 if shard > 1 else 130)
    odd = [(750, None), (751, [None] + [1.0] * 7), (752, [float("nan")] * 8), (800, [float("inf")] * 8), (850, [0.0] * 8), (900, [0.0] * 8), (None, [9.0] * 8),
           (950, [1.0] * 3), (951, [2.0] * 3), (50, [0.5] * 8), (1000, []), (1001, []), (-50, [-1.0 / 512] * 8), (1050, [1.5] * 5)]
    assert top(spark, rows + odd, shard=shard, leaf=leaf, block=block) == top_brute(rows + odd)


def test_ball_tree_beyond_doubles(spark):
    rows = [(i, [float(3 ** (i % 40)) * (-1) ** i, 1e9 + i, 2.0**40 - i]) for i in range(0, 400, 5)] + [(50, [1e300, -1e300, 1.0]), (51, [1e300, 1e300, 1.0])]
    assert top(spark, rows, leaf=3) == top_brute(rows)
    assert top(spark, [], leaf=3) == [] and top(spark, [(50, [1.0])]) == []


def test_ball_tree_skips_nodes():
    """Branch and bound reads few leaves where vectors lie in clusters."""
    rng = np.random.default_rng(1)
    centre = 300 * rng.normal(size=(40, 16))
    x = np.floor(centre[np.repeat(np.arange(40), 100)] + rng.normal(size=(4000, 16)))
    tree = ball_search.Tree(x, np.arange(4000), np.arange(4000), leaf=50)
    seen = []

    class Counted(ball_search.Search):
        def visit(self, tree, query, node):
            seen.append(len(query))
            super().visit(tree, query, node)

    s = Counted(x[::100].copy(), np.arange(0, 4000, 100), np.full(40, ball_search._NONE), np.full(40, ball_search._LONG), 5)
    s.run(tree)
    assert sum(seen) < 0.2 * 40 * 2**tree.depth
    full = x[::100] @ x.T
    for q in range(40):
        mine = s.found[0] == q
        order = sorted((-full[q, j], j) for j in range(4000) if j != q * 100)[:5]
        assert [(-a, b) for a, b in zip(s.found[1][mine], s.found[2][mine])] == order
