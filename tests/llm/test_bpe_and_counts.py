import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from lakeindex.llm.bpe import EncodedText, Prefixes, decode_documents, digest_documents, encode_documents, encoder  # noqa: E402
from lakeindex.llm.token_counts import attribute, field_tokens, section_tokens  # noqa: E402

E = encoder(None, None)
TEXTS = ["", "Hello world!! it's  1234 x", "naïve café ñandú Straße 日本語 🙂🙂", "\n\n  \t a\r\n", "a" * 5000, "ab" * 700 + "'ll", "1" * 999, "!?#" * 300, "étéétéété" * 50, "́́x", " " * 200 + "y"]


@pytest.fixture(scope="module")
def library():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rng):
    return "".join(rng.choice(["the", "ing", " ", "é", "ß", "1", "\n", "'s", "x", "日", "!", "A", "qu", "  "]) for _ in range(rng.randrange(120)))


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    for text in TEXTS + [noise(rng) for _ in range(400)]:
        ids = E.encode(text)
        assert ids == library.encode_ordinary(text)
        assert E.decode(ids) == text.encode()


def test_every_prefix_appends_and_edits_are_exact(library):
    rng = random.Random(2)
    piece = b"internationalisation\xc3\xa9\xc3\xa9aaaaabbbb"
    p = Prefixes(E.vocabulary, b"")
    for i in range(len(piece)):
        p.append(piece[i : i + 1])
        assert p.ids() == Prefixes(E.vocabulary, piece[: i + 1]).ids()
    for _ in range(50):
        a, b = sorted(rng.randrange(len(p.bytes) + 1) for _ in range(2))
        p.edit(a, b, rng.choice([b"", b"x", b"tion", b"\xc3\xa9"]))
        assert p.ids() == Prefixes(E.vocabulary, p.bytes).ids()
    t = EncodedText(E, noise(rng))
    for _ in range(300):
        a, b = sorted(rng.randrange(len(t.text) + 1) for _ in range(2))
        b = min(b, a + 5)
        t.edit(a, b, noise(rng)[:8]) if rng.random() < 0.7 else t.append(noise(rng)[:6])
        assert t.ids() == library.encode_ordinary(t.text)


def test_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, digest_documents(df).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = encode_documents(df)
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in decode_documents(encoded).where("doc_id is not null").collect()) == sorted((i, t) for i, t in rows if i is not None)
    assert digest_documents(df.limit(0)).collect() == []


def test_attribution_rules():
    spans = lambda *x: (np.array([a for a, _ in x]), np.array([b for _, b in x]))
    tokens, sections = spans((0, 3), (3, 6), (6, 8), (8, 9)), spans((0, 4), (4, 7))
    assert [x if isinstance(x, int) else x.tolist() for x in attribute(*tokens, *sections, "majority")] == [[1, 2], 1, 2]
    assert attribute(*tokens, *sections, "start")[0].tolist() == [2, 1] and attribute(*tokens, *sections, "end")[0].tolist() == [1, 1]


def test_sections_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS + [noise(rng) for _ in range(60)])] + [(99, None)]
    got = {r.doc_id: r for r in section_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        t = t or ""
        lines = [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        owner = [k for k, line in enumerate(lines) for _ in line]
        counts, at, data = [0] * len(lines), 0, t.encode()
        char = [k for k, c in enumerate(t) for _ in c.encode()]
        for token in E.encode(t):
            n = len(E.vocabulary.tokens[token])
            own = [owner[c] for c in range(char[at], char[at + n - 1] + 1)]
            counts[max(sorted(set(own)), key=own.count)] += 1
            at += n
        assert at == len(data) and got[i].section_tokens == counts and got[i].n_tokens == sum(counts)


def test_fields(spark):
    df = spark.createDataFrame([(1, "a title", "the body text"), (2, None, "x"), (3, None, None)], "doc_id long, title string, body string")
    got = {r.doc_id: r for r in field_tokens(df, ["title", "body"]).collect()}
    assert all(sum(r.section_tokens) + r.unattributed == r.n_tokens for r in got.values())
    assert got[1].section_tokens == [2, 3] and got[2].section_tokens == [0, 1] and got[3].section_tokens == [0, 0]
