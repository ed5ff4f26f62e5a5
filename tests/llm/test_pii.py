import hashlib
import random
import re

from lakeindex.llm.pii import KINDS, digest_spans, find_spans, redact

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(RULES):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    "", "mail a.b+c@x-y.example.com, or a@b", "x@y.zz_q@w.org a@@b.c @b.c .@-.- é@é.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 0000.0000000.1.1 1..2.3.4 9999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111-", "1" * 3000 + " 4111111111111111", "+1 (743) 555-3824. +49 30 1234567 + 1 +1", "+" + "1 " * 4000, "日本🙂 a@b.co 🙂 +1 (743) 555-3824 é",
    "a" * 30000 + "@b.co " + "x." * 2000, "ip 10.0.0.1\nnext\n10.0.0.2\r\n", "a@b.c" * 50, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907f1\" and 5105105105105100", "call (743) 555-3824 or write jo.doe (at) mail (dot) com",
]


def noise(rng):
    return "".join(rng.choice(["1", "2", "12", "255", "4111111111111111", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "@x.y", "\n", "é", "_"]) for _ in range(rng.randrange(60)))


def test_base_spans_against_plain_rules(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS + [noise(rng) for _ in range(1500)])] + [(-1, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in digest_spans(find_spans(df)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t or "")
        r = got[i]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in dict(RULES)] == want, (t, r.spans)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k, _ in RULES]


def test_added_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, "on 2023-05-17 the well-known-state-of-the-art-42 and 1234-5678 isbn 123456789"), (50, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in digest_spans(find_spans(df)).collect()}
    assert got[12].startswith("secret:9:49") and "number:5:19" in got[13] and "address" in got[13] and got[50] == ""
    assert find_spans(df.limit(0)).collect() == []


def test_redaction(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(99, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gap int")
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert redact(df).columns == df.columns and out[99] is None and out[0] == ""
    assert out[8] == "日本🙂 <EMAIL> 🙂 <PHONE> é" and out[10] == "ip <IP>\nnext\n<IP>\r\n" and out[12] == 'token = "<SECRET>" and <CARD>'
    assert all(not any(x.startswith("email") for x in base(t or "")) for t in out.values())


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string").coalesce(1)
    for made in (digest_spans(find_spans(df)), redact(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow", plan)


def test_redaction_masks_whole_spans_that_overlap(spark):
    texts = ["call +33.1.23.45.67.89 now", "🙂 +10.20.30.40.50, a@b.org", "x +1 4111 1111 1111 1111 y +1.2.3.4.56.78.90 z", *TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in find_spans(df).collect()}
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[0] == "call <IP> now"
    for i, t in enumerate(texts):
        regions = []
        for s in spans[i]:
            k = KINDS.index(s.kind)
            if regions and s.start < regions[-1][1]:
                regions[-1] = [regions[-1][0], max(regions[-1][1], s.end), min(regions[-1][2], k)]
            else:
                regions.append([s.start, s.end, k])
        made, at = "", 0
        for start, end, k in regions:
            made, at = made + (t or "")[at:start] + f"<{KINDS[k].upper()}>", end
        assert out[i] == (None if t is None else made + t[at:])


def test_added_kinds_on_examples_not_learnt_from(spark):
    from lakeindex.llm.pii import ADDED, _examples

    rng = random.Random(77)  # the trees learn from another seed's
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, truth = [], []
    for i, e in enumerate(_examples(rng)):
        before = words(12) + " " + e["before"].lstrip()
        rows.append((i, before + e["m"] + " " + words(10)))
        truth.append((e["kind"], len(before), len(before) + len(e["m"]), e["y"]))
    rows.append((len(rows), "He waited at home. Then they met at work. And at seven. Later it ended."))
    got = {r.doc_id: r.spans for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in ADDED:
        hits = [(any(s.kind == kind and s.start < b and a < s.end for s in got[i]), y) for i, (k, a, b, y) in enumerate(truth) if k == kind]
        found = [y for hit, y in hits if hit]
        assert sum(found) >= 0.95 * len(found) and sum(found) >= 0.9 * sum(y for _, y in hits), kind
    assert got[len(rows) - 1] == []
