import random

from pyspark.sql import functions as F

from lakeindex.llm.mixing import mix_sources, repeat_documents, targets, tilts


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level >= cap * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, s, "w " * n if n is not None else None, "clash", 9) for i, s, n in rows], "doc_id long, source string, text string, size string, copies int")


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None, "é", "z"]), int(rng.lognormvariate(4, 1))) for i in range(4000)] + [(9000, "tiny", 3), (9001, "b", None), (9002, "b", 0)]
    df = table(spark, rows)
    got = mix_sources(df).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken", "copies").collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = shares(sizes)
    assert len(got) == len(rows) and abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 3, (s, taken[s], t)
    again = mix_sources(df.repartition(7)).select("doc.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in got)
    repeated = repeat_documents(mix_sources(df))
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in got)


def test_newton_solves_the_dual_with_priors_and_caps(spark):
    rows = [("a", 1.0, 100.0, 150.0), ("a", 4.0, 50.0, 150.0), ("b", 0.5, 10.0, 0.01), ("c", 2.0, 10.0, 30.0), (None, 1.0, 7.0, 7.0), ("none", 1.0, 0.0, 0.0)]
    mass = spark.createDataFrame(rows, "source string, prior double, mass double, target double")
    got = {r.source: r.tilt for r in tilts(mass, 3.0).collect()}
    import math

    for s, t in got.items():
        total = sum(m * min(3.0, p * math.exp(t)) for name, p, m, _ in rows if name == s)
        target = next(x[3] for x in rows if x[0] == s)
        assert abs(total - target) <= 1e-6 * target
    assert set(got) == {"a", "b", "c", None}


def test_empty_and_unsized(spark):
    assert mix_sources(table(spark, [])).collect() == []
    got = mix_sources(table(spark, [(1, "a", None), (2, None, 0), (None, "b", 0)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    only = spark.createDataFrame([("s", 10)], "source string, size long")
    assert targets(only).select("target").first()[0] == 10.0
