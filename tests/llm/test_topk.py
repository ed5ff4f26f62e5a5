import random

import numpy as np

from lakeindex.llm.topk import Index, top_k


def brute(rows, queries, k):
    import math

    clean = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k_own, (i, q) in enumerate(clean):
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(clean) if n != k_own and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def check(spark, data, k=5, **blocks):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 5 = 0"), k, **blocks).collect()))
    assert got == brute([r[:2] for r in data], {r[0] for r in data if r[0] is not None and r[0] % 5 == 0}, k)


def test_agrees_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.12) for _ in range(16)], "x") for i in range(700)]
    rows += [(1000 + i, [round(rng.gauss(0, 0.3), 1) for _ in range(16)], "x") for i in range(60)]  # ties
    check(spark, rows)
    check(spark, rows, rows=100, block=30)
    check(spark, [(i, [rng.choice([0.0, 0.0, 0.0, 1.0]) for _ in range(16)], "x") for i in range(300)])


def test_odd_rows(spark):
    check(spark, [(0, None, ""), (5, [1.0, None], ""), (10, [float("nan"), 1.0], ""), (15, [float("inf"), 0.0], ""), (20, [], ""), (None, [1.0, 1.0], "")])
    check(spark, [(0, [1.0, 2.0], ""), (5, [1.0, 2.0], ""), (5, [1.0, 2.0], ""), (5, [3.0, -2.0], ""), (10, [0.0, 0.0], ""), (3, [1.0], ""), (0, [0.5, 0.5], "")])
    check(spark, [])


def test_many_copies_and_long_vectors(spark):
    rng = random.Random(2)
    one = [rng.gauss(0, 0.1) for _ in range(300)]
    rows = [(i % 30, one if i % 3 else [rng.gauss(0, 0.1) for _ in range(300)], "x") for i in range(120)]
    check(spark, rows, rows=20, block=7)
    check(spark, [(i, [x * 1e6 for x in v], r) for i, v, r in rows[:90]])  # too large for sums in halves of a number


def test_half_of_the_postings_prove_the_rest_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8192, 64))
    v = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    index, shares = Index(np.arange(8192), v), []
    for i in range(0, 400, 50):
        ids, rows, scores, read = index.search(v[i], 5, i)
        exact = v @ v[i]
        exact[i] = -(10**9)
        best = np.lexsort((np.arange(8192), -exact))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist() and (rows == 1).all()
        shares.append(read)
        low = index.search(v[i], 5, i, int(scores[-1]))
        assert low[0].tolist() == best.tolist() and low[3] <= read
    assert np.mean(shares) < 0.65


def test_proofs_start_where_the_last_one_held():
    """Queries of one kind need as many postings; what is read at once needs no proofs before. All stay exact, easy and hard ones in turn."""
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(4000, 32)) / 6).astype(np.int64)
    v[:20] = 0
    index, firsts = Index(np.arange(4000) // 2, v), []
    for i in [*range(30), *range(100, 130)]:
        q = v[i] if i % 3 else np.where(np.arange(32) == i % 32, 900, 0)
        ids, rows, scores, _ = index.search(q, 5, i // 2)
        exact = v @ q
        exact[(np.arange(4000) // 2 == i // 2) & (v == q).all(axis=1)] = -(10**9)
        best = np.lexsort((np.arange(4000) // 2, -exact))[:5]
        assert ids.tolist() == (best // 2).tolist() and scores.tolist() == exact[best].tolist()
        firsts.append(index.first)
    assert max(firsts) > 1
