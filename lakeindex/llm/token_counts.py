"""Token counts of sections and fields by offset-mapped attribution.

A text is encoded once, as a whole. Tokens become spans of characters, and an interval join with the sorted spans of sections
gives each token to a section. A token that crosses a border goes by an explicit rule:

* "majority": to the section that holds most of its characters; of equal shares, to the first (the default);
* "start": to the section of its first character;
* "end": to the section of its last character.

Tokens of characters outside all sections count as unattributed, never twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeindex.llm.bpe import encoder
from lakeindex.llm.common import prepare, tidy

RULES = ("majority", "start", "end")


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 characters of tokens of these byte lengths; a token within a character spans that character."""
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int, int]:
    """Of token spans and sorted disjoint sections: tokens of each section, tokens of none, tokens that cross a border."""
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), len(starts), 0
    first = np.searchsorted(stop, starts, side="right")  # the first section that ends after the token begins
    last = np.searchsorted(begin, ends - 1, side="right") - 1  # the last section that begins before it ends
    hit = first <= last
    inside = hit & (first == last) & (begin[np.minimum(first, n - 1)] <= starts) & (ends <= stop[np.minimum(first, n - 1)])
    counts = np.bincount(first[inside], minlength=n)
    none, crossing = int((~hit).sum()), 0
    for t in np.flatnonzero(hit & ~inside):
        crossing += 1
        a, b = int(first[t]), int(last[t])
        if rule == "majority":
            shares = [min(stop[k], ends[t]) - max(begin[k], starts[t]) for k in range(a, b + 1)]
            outside = ends[t] - starts[t] - sum(shares)
            k = a + int(np.argmax(shares)) if max(shares) >= outside else None
        else:
            at = starts[t] if rule == "start" else ends[t] - 1
            k = next((k for k in range(a, b + 1) if begin[k] <= at < stop[k]), None)
        if k is None:
            none += 1
        else:
            counts[k] += 1
    return counts, none, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A section for each line, its line end included; an empty text has none."""
    at = [i + 1 for i, c in enumerate(text) if c == "\n"] if len(text) < 64 else (np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1).tolist()
    cuts = np.array([0, *at] if at and at[-1] == len(text) else [0, *at, len(text)], np.int64)
    return (cuts[:-1], cuts[1:]) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(path, pattern, rule, spans):
    def run(batches):
        e = encoder(path, pattern)
        lengths = np.array([len(t) for t in e.vocabulary.tokens], np.int64)
        for batch in batches:
            given = batch.column(2).to_pylist() if spans else None
            out = {"n_tokens": [], "section_tokens": [], "unattributed": [], "crossing": []}
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                ids = np.frombuffer(e.packed(text), "<u4")
                starts, ends = token_spans(text.encode("utf-8", "replace"), lengths[ids])
                if given is None:
                    begin, stop = line_sections(text)
                else:
                    pairs = given[i] or []
                    begin, stop = (np.array([p[k] for p in pairs], np.int64) for k in ("start", "end"))
                    if (begin[1:] < stop[:-1]).any() or (begin > stop).any():
                        raise ValueError("sections must be sorted and must not overlap")
                counts, none, crossing = attribute(starts, ends, begin, stop, rule)
                for k, v in (("n_tokens", len(ids)), ("section_tokens", counts.tolist()), ("unattributed", none), ("crossing", crossing)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["section_tokens"], pa.list_(pa.int64())), pa.array(out["unattributed"], pa.int64()), pa.array(out["crossing"], pa.int64())], ["doc_id", *out])
        e.rest()

    return run


OUT = "doc_id long, n_tokens long, section_tokens array<long>, unattributed long, crossing long"


def section_tokens(docs: DataFrame, spans_column: str | None = None, rule: str = "majority", path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, section_tokens, unattributed, crossing), one for each document.

    Sections are the lines of the text (line ends included), or the sorted disjoint spans (start, end), in characters, of an
    array column. section_tokens holds a count for each section; with `unattributed` the counts add up to n_tokens. Null
    texts count as empty: no tokens; no lines; sections given for them get 0. Null spans count as no sections; overlapping or
    unsorted ones are an error. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    prepare(docs.sparkSession)
    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    if spans_column:
        columns.append(F.transform(spans_column, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("spans"))
    return docs.select(*columns).mapInArrow(tidy(_count(path, pattern, rule, bool(spans_column))), OUT)


def field_tokens(rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "majority", id_column: str = "doc_id", **options) -> DataFrame:
    """Counts of the tokens of several string columns, encoded once as one text joined by the separator.

    section_tokens holds a count for each field in the given order; what the separator holds alone counts as unattributed.
    A null field counts as empty.
    """
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    gap, spans, at = len(separator), [], F.lit(0).cast("long")
    for v in values:
        end = at + F.length(v)
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end + gap
    made = rows.select(F.col(id_column).alias("doc_id"), F.concat_ws(separator, *values).alias("text"), F.array(*spans).alias("spans"))
    return section_tokens(made, "spans", rule, **options)
