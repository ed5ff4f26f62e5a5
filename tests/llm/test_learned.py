import random
import re
import zlib

import numpy as np

from lakeindex.llm.langid import Codes, codewords, fit, identify
from lakeindex.llm.quality import IsolationForest, quality_rules, statistics
from lakeindex.llm.toxicity import fit as fit_toxicity
from lakeindex.llm.toxicity import label_model, patterns, score_documents

WORDS = {"en": "the and that with from have this will your about they would there".split(), "fr": "les des une dans pour avec être sont mais nous très où été".split(), "de": "der die und nicht eine ist über mit auch für größe schön".split()}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 5, 6, 20):
        c = codewords(n)
        apart = (c[:, None] != c[None]).sum(2)
        assert len(c) == n and (apart[~np.eye(n, dtype=bool)] >= max(1, c.shape[1] // 4)).all()


def test_decoding_corrects_a_wrong_bit_and_flags_ties():
    c = codewords(4)
    model = Codes(list("abcd"), c, np.zeros((0, 0)), np.zeros(0), np.ones(c.shape[1]))
    margins = c[2] * 3.0
    margins[0] *= -1
    best, share, close = model.decode(np.stack([margins, np.zeros(c.shape[1])]))
    assert best[0] == 2 and share[0] > 0.5 and not close[0] and close[1]


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 60))), lang) for i in range(600) for lang in [rng.choice(list(WORDS))]]
    odd = [(1001, None, "en"), (1002, "123 !!", "fr"), (1003, "", None), (1004, "l" * 200_000, None), (1005, rows[0][1].upper(), None), (1005, rows[0][1].upper(), None)]
    got = {}
    for r in identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect():
        got.setdefault(r.doc_id, r)
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.97
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1005].lang_pred == rows[0][2]
    # Neither lang nor source nor id of a row changes its prediction.
    blind = spark.createDataFrame([(i, t, lang if crc(i, 4) != 2 else "xx") for i, t, lang in rows] + odd, "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify(blind).collect() if r.doc_id < 1000} == {i: (got[i].lang_pred, got[i].score) for i, _, _ in rows}
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_statistics_against_brute_force():
    rng = random.Random(2)
    for text in ["", "a", " \n ", "a b c a b c", "x x x x", "#\n#\n\n \n#", "é é ☃"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(150))) for _ in range(300)]:
        assert statistics(text)[0] == brute(text), text


def test_forest_isolates_the_odd_row():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    scores = IsolationForest(rows).scores(rows)
    assert scores.argmax() == 500 and scores[500] > 0.6 > np.median(scores)
    assert IsolationForest(np.zeros((0, 3))).scores(rows).tolist() == [0.0] * 501 and np.isfinite(IsolationForest(np.zeros((9, 3))).scores(np.zeros((2, 3)))).all()


def test_quality_rules(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300)))
    rows = [(i, good()) for i in range(500)] + [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "%%"]) for w in good().split())) for i in range(20)] + [(2000, None), (2001, "short"), (2002, "a b c " * 100)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i % 2 == 0] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    for i, t in rows:
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == statistics(t or "")[0]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert np.mean([got[i].kept for i in range(500)]) >= 0.97 and not any(got[1000 + i].kept for i in range(20))
    nobody = quality_rules(df, labels.limit(0)).where("kept <> (not base_failed)").count()
    assert nobody == 0 and quality_rules(df.limit(0), labels.limit(0)).count() == 0


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.2
    good = np.stack([(rng.random(3000) < np.where(truth, 0.5, 0.01)) for _ in range(5)], 1)
    votes = np.concatenate([good, rng.random((3000, 2)) < 0.1], 1).astype(float)
    labels = np.where(rng.random(3000) < 0.1, ~truth, truth).astype(float)
    p = label_model(votes, labels)
    assert ((p > 0.5) == truth).mean() > (labels == truth).mean() + 0.03


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum", "blötzix"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        words = [rng.choice("alpha beta gamma delta words plain other things said here".split()) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice([rng.choice(bad), "lostrum" + rng.choice(["a", "en", "er", "isch", "ung"])]).upper()
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic if rng.random() < 0.97 else not toxic)))
    truth = {i: "LOSTRUM" in t or any(b.upper() in t for b in bad) for i, t in rows}
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "idiot moron")], "doc_id long, text string")
    ldf = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_documents(df, ldf).collect()}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (crc(i, 3) == 1) for i in truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    found, real = [i for i in held if got[i].predicted], [i for i in held if truth[i]]
    assert len(set(found) & set(real)) >= 0.95 * len(real) and len(set(found) - set(real)) <= 0.01 * len(held)
    assert got[5000].predicted == got[5001].predicted == 0 and got[None].predicted == 1
    # Labels of held-out rows change nothing.
    blind = ldf.where("doc_id is null or crc32(cast(doc_id as string)) % 3 <> 1")
    assert {r.doc_id: r.score for r in score_documents(df, blind).collect()} == {i: r.score for i, r in got.items()}
    assert score_documents(df, ldf.limit(0)).where("predicted = 1").count() == 0


def test_patterns_see_the_whole_text():
    assert patterns("word " * 5000 + "sooooo")[2] and not patterns("word " * 5000 + "so")[2]
    assert patterns("WORD " * 5000)[0] and not patterns("WORD " * 5000 + "small")[0]


def test_rare_languages_keep_a_codeword(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS["de" if i % 2 else "en"]) for _ in range(5)), "de" if i % 2 else "en") for i in range(2000)] + [(5000 + i, "kaj estas tio", "eo") for i in range(2)]
    rows += [rows[-1]] * 3
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert model.languages == ["de", "en", "eo"] and len(model.codes) == 3


def test_more_than_1500_words_vote(spark):
    rng = random.Random(5)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1800)]
    toxic = [[] for _ in range(200)]
    for w in words:
        for i in rng.sample(range(200), 8):
            toxic[i].append(w)
    rows = [(i, " ".join(ws), 1) for i, ws in enumerate(toxic)] + [(1000 + i, f"w{i} plain", 0) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert set(words) <= fit_toxicity(df.drop("toxic"), df.drop("text")).voters.keys()
