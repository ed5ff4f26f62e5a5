"""Personal data in texts, with DataFrame expressions only.

Generators propose spans with high recall: the four base kinds, whose rules are exact, and looser shapes (opaque strings, long
numbers, spelled-out mail addresses) that may overlap them. Boosted trees score the looser candidates by features of their format
and of the text before them; each kind has a threshold, calibrated for precision. The trees are fitted on the driver on a fixed
set of made-up examples and become nested CASE expressions, so texts never leave the JVM.

A pattern's spans come from two passes of the same pattern: the matches and the gaps between them. Their lengths add up to
positions. Patterns are possessive, and start at the start of a run of their characters, so long runs cost linear time; the
rules that they state are those of the plain patterns named beside them.

The base patterns have no bounds. The added shapes have, as what they look for is short, and a bound keeps a pattern that may
backtrack linear: an opaque string has 16 characters or more and a digit among its first 65; a long number has 8 to 24
characters, as phone, account and insurance numbers have; a spelled-out address has parts of at most 64 characters (the most that
a mailbox or a host's label may have), at most 4 of them after its host's first. What is longer is no added span.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base kinds in the order in which spans with one start are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
ADDED = ("secret", "number", "address")
KINDS = BASE + ADDED
EXAMPLES, TREES, RATE = 1600, 24, 0.4
PRECISION = 0.97
BEFORE = 24  # characters of context before a candidate


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: A cheap test that holds for every text with a match.
    guard: str


GENERATORS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Generator("secret", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]{0,64}[0-9])[A-Za-z0-9_/+=-]{16,}+", r"[A-Za-z0-9_/+=-]{16}"),
    Generator("number", r"(?<![0-9A-Za-z+])\(?[0-9][0-9() ./-]{6,22}[0-9](?![0-9A-Za-z])", r"[0-9][0-9() ./-]{6}"),
    Generator("address", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]{2,64}+){1,4}", r"\(at\)|\[at\]| at "),
)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every second digit doubles, and the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind's pattern counts."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def format_features(before: Column, m: Column) -> dict[str, Column]:
    """What trees see of a candidate and of the text before it."""
    n = F.greatest(F.length(m), F.lit(1))
    share = lambda p: F.length(F.regexp_replace(m, p, "")) / n
    cue = lambda words: F.lower(before).rlike(rf"(?:{words})[^\n]{{0,12}}$").cast("double")
    return {
        "length": F.length(m).cast("double"),
        "digits": share("[^0-9]"),
        "letters": share("[^A-Za-z]"),
        "upper": share("[^A-Z]"),
        "not_hex": share("[0-9a-fA-F]"),
        "marks": share("[A-Za-z0-9]"),
        "n_digits": F.length(_digits(m)).cast("double"),
        "turns": F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[^9]", "")) / n,
        "cue_secret": cue("token|secret|passw|passwd|api[_ -]?key|bearer|auth|private key|access[_ -]?key"),
        "cue_number": cue("phone|tel|call|mobile|fax|ssn|account|iban|passport|whatsapp|dial"),
        "cue_mail": cue("mail|contact|write|reach"),
        "assigned": before.rlike("[=:]\\s{0,2}[\"']?$").cast("double"),
    }


def _examples(rng: random.Random) -> list[dict]:
    """Made-up candidates of the added kinds with what they are; a third of each kind are look-alikes."""
    word = lambda n=None: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n or rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(4)) + " "
    opaque = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(20, 64)))
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for _ in range(EXAMPLES // 3):
        bad = rng.random() < 0.4
        if bad:
            m = rng.choice([lambda: "-".join(word() for _ in range(3)) + "-" + digits(2), lambda: word(14) + digits(3), lambda: "/".join(word() for _ in range(3)) + "/" + digits(4), lambda: "=" * 18 + digits(2), lambda: word(8) + "_" + word(9) + digits(1), lambda: digits(16)])()
            before = rng.choice([prose(), prose() + word() + ": "])
        else:
            m = opaque(rng.choice([hexes, hexes, base]))
            before = prose() + rng.choice(["token = \"", "api_key: ", "secret=", "password: ", "Bearer ", "access key = '", "token: "]) if rng.random() < 0.85 else prose()
        out.append({"kind": "secret", "before": before[-BEFORE:], "m": m, "y": int(not bad)})
        bad = rng.random() < 0.6
        if bad:
            m = rng.choice([lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(3)}.{digits(6)}", lambda: digits(9), lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: digits(16), lambda: f"{digits(3)} {digits(3)} {digits(3)}"])()
            before = rng.choice([prose(), prose() + "no. ", prose() + "on ", prose() + "isbn "])
        else:
            m = rng.choice([lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(3)} {digits(7)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: digits(10)])()
            before = prose() + rng.choice(["phone: ", "tel ", "call ", "mobile ", "ssn ", "account ", "fax: ", "dial "])
        out.append({"kind": "number", "before": before[-BEFORE:], "m": m, "y": int(not bad)})
        bad = rng.random() < 0.5
        if bad:
            m, before = f"{word()} at {word()}.{word()}", prose()
        else:
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
            m, before = f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}", prose() + rng.choice(["mail ", "contact: ", "write to ", ""])
        out.append({"kind": "address", "before": before[-BEFORE:], "m": m, "y": int(not bad)})
    return out


def boost(x: list[list[float]], y: list[int]) -> tuple[float, list[tuple]]:
    """Trees of two levels fitted to the log loss by second-order steps: (base score, [(feature, cut, subtree, subtree)])."""
    import numpy as np

    a, t = np.array(x, float), np.array(y, float)
    base = math.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))
    score, trees = np.full(len(t), base), []
    cuts = [np.unique(np.quantile(a[:, f], np.linspace(0.02, 0.98, 25))) for f in range(a.shape[1])]

    def split(rows, g, h, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(-RATE * total_g / (total_h + 1.0))
        best = (1e-6, None)
        if depth:
            for f, each in enumerate(cuts):
                v = a[rows, f]
                for c in each:
                    low = v <= c
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] and 5 <= low.sum() <= len(rows) - 5:
                        best = (gain, (f, float(c)))
        if best[1] is None:
            return leaf
        f, c = best[1]
        low = a[rows, f] <= c
        return f, c, split(rows[low], g, h, depth - 1), split(rows[~low], g, h, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = split(np.arange(len(t)), p - t, p * (1 - p), 2)
        trees.append(tree)
        score += np.array([value(tree, r) for r in a])
    return base, trees


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def threshold(scores: list[float], y: list[int], precision: float = PRECISION) -> float:
    """The lowest score from which on at least this share of the examples is right; above all if none."""
    ranked, right, best = sorted(zip(scores, y), reverse=True), 0, math.inf
    for i, (s, t) in enumerate(ranked):
        right += t
        if right >= precision * (i + 1) and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            best = s
    return best


_MODELS: dict[str, tuple] = {}


def models(spark: SparkSession) -> dict[str, tuple]:
    """For each added kind (base score, trees, threshold). Features come from the same expressions that score texts."""
    if not _MODELS:
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(_examples(random.Random(3)))), "array<struct<kind:string,before:string,m:string,y:int>>")).alias("e")).select("e.*")
        names = list(format_features(F.col("before"), F.col("m")))
        got = rows.select("kind", "y", F.array(*format_features(F.col("before"), F.col("m")).values()).alias("x")).collect()  # EXAMPLES rows
        for kind in ADDED:
            own = [(r.x, r.y) for r in got if r.kind == kind]
            learn, check = [r for i, r in enumerate(own) if i % 3], [r for i, r in enumerate(own) if not i % 3]
            base, trees = boost([x for x, _ in learn], [y for _, y in learn])
            scores = [base + sum(value(t, x) for t in trees) for x, _ in check]
            _MODELS[kind] = base, trees, threshold(scores, [y for _, y in check]), names
    return _MODELS


def score(model: tuple, f: dict[str, Column]) -> Column:
    """The model's score as nested CASE expressions."""
    base, trees, _, names = model

    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[names[tree[0]]] <= F.lit(tree[1]), case(tree[2])).otherwise(case(tree[3]))

    total = F.lit(float(base))
    for t in trees:
        total = total + case(t)
    return total


def accepted(g: Generator, model: tuple | None, before: Column, m: Column) -> Column:
    """Whether a candidate is personal data: the base rule, or the trees' score against the kind's threshold."""
    if g.kind in BASE:
        return valid(g.kind, m)
    return score(model, format_features(before, m)) >= F.lit(model[2] - 1e-6 if math.isfinite(model[2]) else 1e9)  # sums may differ in their last digits


def _candidates(g: Generator, text: Column, each) -> Column:
    """An array of each(gap before, match); without the guard's hint, an empty one at the price of one search."""
    made = F.zip_with(F.split(text, g.pattern, -1), F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)), each)
    return F.when(text.rlike(g.guard), made)


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, spans), one for each document: an array of (start, kind, end, base), sorted by start and kind.

    Positions are code points, ends exclusive. Base spans of a kind do not overlap; those of different kinds may. An added span
    that overlaps a base span, or an added one of a kind listed before, is dropped. Null and empty texts have no spans. Rows
    that repeat an id stay apart. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = models(spark)
    text = F.col("_text")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    candidate = lambda k: lambda gap, m: F.struct(F.lit(k).alias("kind"), F.length(gap).alias("gap"), F.right(gap, F.lit(BEFORE)).alias("before"), m.alias("m"))
    made = [_candidates(g, text, candidate(k)) for k, g in enumerate(GENERATORS)]
    none = F.array().cast("array<struct<kind:int,gap:int,before:string,m:string>>")
    all_made = F.filter(F.concat(*[F.coalesce(x, none) for x in made]), lambda c: c["m"].isNotNull())
    each = rows.select("doc_id", "_row", F.posexplode_outer(all_made).alias("pos", "c")).select("doc_id", "_row", "pos", "c.kind", "c.gap", "c.before", "c.m")
    w = Window.partitionBy("_row", "kind").orderBy("pos")
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(w)).withColumn("start", F.col("end") - F.length("m"))
    ok = F.lit(None).cast("boolean")
    for k, g in reversed(list(enumerate(GENERATORS))):
        ok = F.when(F.col("kind") == k, accepted(g, known.get(g.kind), F.col("before"), F.col("m"))).otherwise(ok)
    each = each.select("doc_id", "_row", "kind", "start", "end", F.coalesce(ok, F.lit(False)).alias("ok"))
    # A span of rank r gives way to accepted spans of lower rank that overlap it; base kinds share rank 0.
    rank = F.greatest(F.lit(0), F.col("kind") - (len(BASE) - 1))
    each = each.withColumn("rank", F.when(F.col("ok"), rank))
    order = Window.partitionBy("_row").orderBy("start", "end")
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    clash = F.lit(False)
    for r in range(len(ADDED)):
        lower = F.col("rank") <= r
        over = (F.max(F.when(lower, F.col("end"))).over(up) > F.col("start")) | (F.min(F.when(lower, F.col("start"))).over(down) < F.col("end"))
        clash = clash | ((F.col("rank") > r) & F.coalesce(over, F.lit(False)))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("k"), kind.alias("kind"), F.col("end").cast("long").alias("end"), (F.col("kind") < len(BASE)).alias("base"))
    each = each.select("doc_id", "_row", F.when(F.col("ok") & ~clash, span).alias("span"))
    return each.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("doc_id", F.transform("spans", lambda s: s.dropFields("k")).alias("spans"))


def digest_spans(found: DataFrame) -> DataFrame:
    """Of rows (doc_id, spans): counts of the base kinds, the SHA-256 of the base spans and all spans as kind:start:end."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans(k: int, model: tuple | None, text: Column) -> Column:
    """An array of (start, end, kind): the accepted candidates of generator k, in their order."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    made = _candidates(GENERATORS[k], text, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def add(a: Column, c: Column) -> Column:
        start = a["at"] + F.length(c["gap"])
        end = start + F.coalesce(F.length(c["m"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(k).alias("kind"))
        ok = c["m"].isNotNull() & accepted(GENERATORS[k], model, F.right(c["gap"], F.lit(BEFORE)), c["m"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    found = F.aggregate(made, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda a: a["found"])
    return F.coalesce(found, none)


def _clear_of(others: Column):
    return lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))


def redact(docs: DataFrame, text_column: str = "text", mark: str = "<{}>") -> DataFrame:
    """The documents with the spans that `find_spans` finds in their text replaced by their kinds' marks; nothing is shuffled.

    Spans that overlap become one, with the mark of the kind that is listed first. All other columns, rows and nulls stay; the
    columns keep their order.
    """
    known, text = models(docs.sparkSession), F.col(text_column)
    marks = F.array(*[F.lit(mark.format(g.kind.upper())) for g in GENERATORS])
    out = docs.select("*", *[_spans(k, known.get(g.kind), text).alias(f"_spans_{k}") for k, g in enumerate(GENERATORS)])
    names = [f"_spans_{k}" for k in range(len(GENERATORS))]
    # An added span gives way to accepted spans of kinds listed before it, as in find_spans.
    kept = [F.col(x) for x in names[: len(BASE)]]
    for k in range(len(BASE), len(names)):
        free = F.filter(names[k], _clear_of(F.concat(*names[:k])))
        kept.append(F.when(F.size(names[k]) > 0, free).otherwise(F.col(names[k])))
    out = out.withColumn("_kept", F.array_sort(F.concat(*kept)))

    def merge(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.least(last["kind"], s["kind"]).alias("kind"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(s)))

    out = out.withColumn("_kept", F.aggregate("_kept", F.array().cast("array<struct<start:int,end:int,kind:int>>"), merge))
    ends = F.concat(F.array(F.lit(0)), F.col("_kept.end"))  # of the text's start and of each region

    def piece(s: Column, i: Column) -> Column:
        at = F.get(F.col("_ends"), i)
        return F.concat(F.substring(text, at + 1, s["start"] - at), F.element_at(marks, s["kind"] + 1))

    out = out.withColumn("_ends", ends)
    rebuilt = F.concat(F.array_join(F.transform("_kept", piece), ""), F.substring(text, F.element_at("_ends", F.lit(-1)) + 1, F.length(text)))
    return out.withColumn(text_column, F.when(F.size("_kept") > 0, rebuilt).otherwise(text)).select(docs.columns)
