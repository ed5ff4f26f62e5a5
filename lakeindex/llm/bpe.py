"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that its encoding ends with. That token is the only suffix of the
prefix, among the vocabulary's, that may stand next to the last token of what precedes it. The table of last tokens holds the
encodings of all prefixes at once: bytes can be appended without touching what is there, and an edit recomputes the table from
the edit on. Whether two tokens may stand side by side follows from the merges that formed them.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeindex.llm.common import prepare, texts, tidy

#: Pieces' encodings, prefixes' last tokens and verdicts on pairs that a worker keeps; it starts anew beyond, so its memory is bounded.
REMEMBERED, PREFIXES, PAIRS = 800_000, 1_200_000, 1_000_000
#: By how much less a lean encoder keeps, which also starts anew with each partition.
LEAN = 6
#: Pieces of more bytes are encoded but not kept.
KEPT_BYTES = 64


class Vocabulary:
    """Tokens by rank. Ids are ranks, and a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest, self.most_pairs = max(map(len, ranks)), PAIRS
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.met: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: a line for each token, its bytes in base 64 and its rank."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; None if merging its bytes does not lead to it. A byte is its own parts."""
        if token not in self.halves:
            whole = self.tokens[token]
            pieces = [whole[i : i + 1] for i in range(len(whole))]
            while len(pieces) > 2:
                pairs = [self.ranks.get(a + b, token) for a, b in zip(pieces, pieces[1:])]
                low = min(pairs)
                if low >= token:
                    break
                at = pairs.index(low)
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            known = [self.ranks[p] for p in pieces if p in self.ranks]
            if len(pieces) == 1:
                self.halves[token] = (token, token)
            else:
                self.halves[token] = (known[0], known[1]) if len(pieces) == 2 == len(known) else None
        return self.halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether these tokens, each the encoding of its bytes, are together the encoding of theirs.

        Goes back in time through the merges that formed them, the latest first, and looks for a merge over the border that
        would have come before the next one. Of equal ranks the leftmost merges first.
        """
        key = left << 32 | right
        if (known := self.met.get(key)) is not None:
            return known
        tokens, ranks, until = self.tokens, self.ranks, len(self.tokens)
        while True:
            over = ranks.get(tokens[left] + tokens[right])
            if over is not None and over < until:
                found = False
                break
            is_byte = len(tokens[left]) == 1, len(tokens[right]) == 1
            if all(is_byte):
                found = True
                break
            if is_byte[1] or not is_byte[0] and left > right:
                until, left = left, self.parts(left)[1]
            else:
                until, right = right + 1, self.parts(right)[0]
        if len(self.met) >= self.most_pairs:
            self.met.clear()
        self.met[key] = found
        return found


class Prefixes:
    """The last tokens of all byte prefixes of a piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.bytes, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact for any bytes: the entries that are there stay."""
        v, data, last, done = self.vocabulary, self.bytes + more, self.last, len(self.bytes)
        get, adjacent, longest = v.ranks.get, v.adjacent, v.longest
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and v.parts(token) is not None and (not start or adjacent(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        self.bytes = data

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes start to end; only what follows start is computed again."""
        rest = self.bytes[end:]
        self.bytes, self.last = self.bytes[:start], self.last[:start]
        self.append(new + rest)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the piece, or of its first `end` bytes."""
        at, out = len(self.bytes) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Maps pieces to their ids as little-endian 32-bit integers; a piece that is missing is encoded."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, lean: bool = False):
        import regex

        super().__init__()
        self.lean, self.most, self.most_prefixes = lean, REMEMBERED // (LEAN if lean else 1), PREFIXES // (LEAN if lean else 1)
        vocabulary.most_pairs = PAIRS // (LEAN if lean else 1)
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        #: Tokens that are the encoding of their own bytes; only they stand in encodings.
        self.whole = {t: i for t, i in vocabulary.ranks.items() if vocabulary.parts(i) is not None}
        self.lengths = [len(t) for t in vocabulary.tokens]
        #: The last token of each known prefix, shared by all pieces that begin with it.
        self.last: dict[bytes, int] = {}

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else self._ids(data) if len(data) <= KEPT_BYTES else Prefixes(self.vocabulary, data).ids()
        packed = pack(f"<{len(ids)}I", *ids)
        if len(data) <= KEPT_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed

    def _ids(self, data: bytes) -> list[int]:
        """As Prefixes does, but from the longest prefix on that an earlier piece has left behind."""
        if len(self.last) >= self.most_prefixes:
            self.last.clear()
        last, get, met, longest = self.last, self.whole.get, self.vocabulary.met, self.vocabulary.longest
        done = len(data)
        while done and data[:done] not in last:
            done -= 1
        for end in range(done + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                left = last[data[:start]]
                fits = met.get(left << 32 | token)
                if self.vocabulary.adjacent(left, token) if fits is None else fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
            last[data[:end]] = token
        at, out = len(data), []
        while at:
            out.append(last[data[:at]])
            at -= self.lengths[out[-1]]
        return out[::-1]

    def rest(self) -> None:
        """At the end of a partition a lean encoder keeps only the verdicts on pairs."""
        if self.lean:
            self.clear()
            self.last.clear()

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


class EncodedText:
    """A text with the ids of its pieces, which appends and edits keep exact."""

    #: Pieces before a change that a pattern's look-ahead may still alter.
    BACK = 2

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.starts = [m.start() for m in encoder.pattern.finditer(text)]
        self.parts = [encoder[m] for m in encoder.pattern.findall(text)]

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.parts), "<u4").tolist()

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end: pieces are split anew from just before the edit until they fall in step again."""
        from bisect import bisect_left

        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        keep = max(0, bisect_left(self.starts, start) - self.BACK)
        at = self.starts[keep] if keep < len(self.starts) else 0
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, parts = self.starts[:keep], self.parts[:keep]
        for m in self.encoder.pattern.finditer(text, at):
            i = old.get(m.start())
            if i is not None and m.start() > start + len(new):
                starts += [s + shift for s in self.starts[i:]]
                parts += self.parts[i:]
                break
            starts.append(m.start())
            parts.append(self.encoder[m.group()])
        self.text, self.starts, self.parts = text, starts, parts


@lru_cache(2)
def encoder(path: str | None, pattern: str | None, lean: bool = False) -> Encoder:
    """One encoder a worker. Without a path, the public multilingual vocabulary of the installed package and its pattern."""
    import public_tokenizers

    return Encoder(Vocabulary.read(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN, lean)


def _encode(path, pattern, digests, lean=False):
    def run(batches):
        import regex  # noqa: F401  fails early where it is missing

        e = encoder(path, pattern, lean)
        for batch in batches:
            counts, ids, one, two = [], [], [], []
            for text in texts(batch.column(1)):
                packed = e.packed(text)
                counts.append(len(packed) // 4)
                if digests:
                    one.append(hashlib.sha256(packed).hexdigest())
                    two.append(hashlib.sha256(e.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
                else:
                    ids.append(packed)
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_tokens", "ids"])
        e.rest()

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text", lean: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), one for each document: its text's ids by the rank file at `path`.

    Each match of the pattern is encoded separately; special tokens are ordinary text. Null counts as the empty text, which
    has no ids. A lean worker remembers a sixth, for executors that hold much else. Ids of documents pass through, null and repeated ones too; other columns are ignored.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(_encode(path, pattern, False, lean)), "doc_id long, n_tokens long, ids array<int>")


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encode_documents, then decodes; rows (doc_id, n_tokens, ids_sha256, decoded_sha256) leave the ids in the worker."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_encode(path, pattern, True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decode(path, pattern):
    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return run


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (doc_id, bytes) of rows (doc_id, ids); null ids count as none."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(tidy(_decode(path, pattern)), "doc_id long, bytes binary")
