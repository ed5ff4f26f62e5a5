import random
import re

import numpy as np

from lakeindex.llm.hashing import shingle_sets
from lakeindex.llm.ngram_jaccard import bitmap, bits_of, fold, jaccard_groups, keep_first, may_link


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, num, den):
    sets, ids = sets_of(rows, n), [r[0] for r in rows]
    link = [[bool(a) and bool(b) and den * len(a & b) >= num * len(a | b) for b in sets] for a in sets]
    name = list(ids)
    for _ in rows:
        name = [min(name[j] for j in range(len(rows)) if link[i][j] or i == j) for i in range(len(rows))]
    return sorted((ids[i], len(sets[i]), name[i], sum(link[i]) - bool(sets[i])) for i in range(len(rows)))


def mutated(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def fixture(seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A B C"), (8, "x " * 4000 + "end")]
    for g in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 9, 40, 120, 400]))]
        rows += [(100 * (g + 1) + k, mutated(rng, words, rng.randrange(0, 1 + len(words) // 30))) for k in range(rng.choice([2, 3, 25]))]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(5000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + shared) for k in range(30)]
    rows += [(6000 + k, shared) for k in range(5)]
    return rows


def test_agrees_with_brute_force(spark):
    for seed, n, num, den in ((1, 4, 85, 100), (2, 5, 80, 100), (3, 3, 1, 2)):
        rows = fixture(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, jaccard_groups(df, n, (num, den)).collect())) == brute(rows, n, num, den)


def test_large_groups_are_split_into_tiles(spark, monkeypatch):
    import lakeindex.llm.ngram_jaccard as m

    monkeypatch.setattr(m, "BLOCK", 4)
    monkeypatch.setattr(m, "GROUP", 8)
    rows = fixture(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.jaccard_groups(df, 4, (85, 100)).collect())) == brute(rows, 4, 85, 100)


def test_empty_table_nulls_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string, n int")
    assert jaccard_groups(empty).collect() == [] and keep_first(empty).collect() == []
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(7, text, "x"), (7, text, "x"), (9, text + " more", "y"), (None, text, "z"), (None, None, "z"), (3, None, None)], "doc_id long, text string, component_id string")
    got = sorted(jaccard_groups(df).collect(), key=str)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in got) == [(-1, 0, -1, 0), (-1, 26, 7, 3), (3, 0, 3, 0), (7, 26, 7, 3), (7, 26, 7, 3), (9, 27, 7, 3)]
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text is None) for r in kept.collect()) == [(-1, False), (-1, True), (3, True), (7, False)]


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        width = min(bits_of(len(a)), bits_of(len(b)))
        x, y = (fold(bitmap(s, bits_of(len(s))), width) for s in (a, b))
        assert (x == bitmap(a, width)).all()
        both = len(np.intersect1d(a, b))
        if 100 * both >= 60 * (len(a) + len(b) - both):
            assert may_link(len(a), x, np.array([len(b)]), y[None], 60, 100)[0]


def test_hashes_do_not_depend_on_chunks():
    import pyarrow as pa

    from lakeindex.llm import hashing

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\t\nZ") for _ in range(rng.randrange(200))) for _ in range(60)] + ["long" * 100, None, ""]
    whole = [w.tolist() for w in hashing.word_hashes(pa.array(texts))]
    assert whole == [w.tolist() for w in hashing.word_hashes(pa.array(texts), 50)]
    assert [len(w) for w in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [len(s) for s in shingle_sets(pa.array(texts), 3)] == [len(s) for s in sets_of([(0, t) for t in texts], 3)]


def test_candidates_of_every_width_are_compared():
    from lakeindex.llm.ngram_jaccard import _Signatures

    rng, sizes = np.random.default_rng(6), np.array([100, 200, 400, 800, 900])
    tokens = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    sig = _Signatures(sizes, [bitmap(tokens[:n], bits_of(n)) for n in sizes.tolist()])
    assert sig.near(4, np.arange(4), 1, 10).tolist() == [0, 1, 2, 3]

def test_words_with_a_regular_structure_do_not_share_a_hash():
    import pyarrow as pa

    from lakeindex.llm.hashing import word_hashes

    for n in (10, 11, 12):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        b = a.translate({97: 98, 98: 97})
        (x,), (y,), (z,) = word_hashes(pa.array([a, b, a.upper()]))
        assert x != y and x == z
    words = ["x" * 63 + "q", "x" * 63 + "r", "x" * 64 + "q", "x" * 65 + "q", "Q" + "x" * 70, "r" + "x" * 70, "é" * 40, "é" * 41]
    one = [h for (h,) in word_hashes(pa.array(words))]
    assert len(set(one)) == len(words) and [h for (h,) in word_hashes(pa.array(words), most=8)] == one


def test_hot_keys_join_like_any_join(spark, monkeypatch):
    import lakeindex.llm.common as m

    monkeypatch.setattr(m, "EVEN", 5)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)], "k long, i long")
    right = left.groupBy("k").count().withColumnRenamed("count", "d").where("k <> 5")
    for hot in (1, 4, 4096):
        monkeypatch.setattr(m, "HOT", hot)
        got = m.hot_join(left, right, ["k"], "d")
        assert got.columns == ["k", "i", "d"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "i", "d").collect()))
    assert m.hot_join(left, right.limit(0), ["k"], "d").count() == 0


def test_components_of_long_paths_and_hubs(spark):
    from lakeindex.llm.components import components

    path = [(i, i + 1) for i in range(100, 400)]
    hub = [(5, 1000 + i) for i in range(300)] + [(1000 + i, 1000 + i) for i in range(9)] + [(None, 7)]
    got = {r.u: r.component for r in components(spark.createDataFrame(path + hub, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {1000 + i: 5 for i in range(300)} | {5: 5}


def test_the_filter_of_ids_grows_with_them():
    from lakeindex.llm.common import LEAST_FILTER, MOST_FILTER, filter_width

    assert [filter_width(n) for n in (0, 1, 4096, 4097, 1 << 23, 1 << 40)] == [LEAST_FILTER, LEAST_FILTER, LEAST_FILTER, 1 << 17, 1 << 27, MOST_FILTER]
