import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "encoding":
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name in ("toxicity", "near_duplicates"):
            assert 0.5 * before < docs.count() <= before
        if name in ("pii", "encoding"):
            assert docs.count() == before
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_against_brute_force(spark, tmp_path):
    """Each stage's decisions made again in plain Python: scores by the fitted scorer, all pairs, plain rules, the library's ids."""
    import base64
    import random
    import re
    from collections import Counter

    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from lakeindex.llm.toxicity import learn
    from tests.llm.test_ngram_jaccard import brute
    from tests.llm.test_pii import RULES, luhn

    rng = random.Random(3)
    words = [f"w{i}x" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["moron", "scum"])
        if rng.random() < 0.3:
            text.insert(3, rng.choice(["ann@mail.example.org", "10.20.30.40", "4111 1111 1111 1111", "+1 (743) 555-3824"]))
        rows.append((i, " ".join(text), "en", rng.choice(["a", "b", "c", None]), 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "b", 0) for i in range(20)] + [(2000, None, None, None, None), (2001, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))

    scorer = learn(docs, known)
    clean = [(r[0], r[1]) for r in rows if scorer.score(r[1] or "") < 0.7]
    assert 200 < len(clean) < 290
    keep = {i for i, _, name, _ in brute(clean, 5, 80, 100) if i == name}

    def masked(text):
        for kind, pattern in RULES:
            def one(m):
                d = re.sub("[^0-9]", "", m.group())
                ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
                return f"<{kind.upper()}>" if ok else m.group()

            text = re.sub(pattern, one, text)
        return text

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(masked(t or "")) for i, t in clean if i in keep}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in got)
    assert all(want[r.doc_id] == r.ids for r in got) and set(times) <= keep and max(times.values()) <= 3
    # The mix takes as many words as there are, and no word more than its source's share.
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", masked(t or ""))) for i, t in clean if i in keep}
    assert abs(sum(size[r.doc_id] for r in got) - sum(size.values())) < 0.05 * sum(size.values())
