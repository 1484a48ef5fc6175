"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact without running merges over the text.  A text is cut where no piece can reach across:
before each run of word marks, and around line breaks.  In such a part, an Aho-Corasick automaton over the
pieces finds all matches; starting from the longest at each place, a piece is accepted if it fits the one
before it, which holds if re-merging the two texts gives back the same two pieces.  Where no piece fits,
the last one is taken back and its place is marked in a bitfield of positions known to fail.  A
segmentation whose neighbours all fit is the one that merging gives.

Pieces of equal score (runs of word marks) are not decided by neighbours alone; such runs are merged
directly.  Characters outside all pieces fall back to their bytes.  Models with a normalizer other than
identity, user-defined pieces, or without byte fallback are refused.

Defined results: a null or empty text has the end id only and decodes to the empty text; texts are taken
whole; repeated rows are encoded alike; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts kept with their ids in each Python worker; the store is emptied when full.
STORE = 400_000
STORED_LENGTH = 48
_coders: dict[str, Coder] = {}


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class _Store(dict):
    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.coder.encode_part(part)
        if len(part) <= STORED_LENGTH:
            if len(self) >= STORE:
                self.clear()
            self[part] = ids
        return ids


class Coder:
    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, trainer, normalizer = [], {}, {}
        for field, value in proto_fields(model):
            if field == 1:
                pieces.append(dict(proto_fields(value)))
            elif field in (2, 3):
                (trainer if field == 2 else normalizer).update(proto_fields(value))
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        self.score = [struct.unpack("<f", p[2])[0] for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(1) != b"identity" or normalizer.get(2) or normalizer.get(4, 1) or USER in self.kind or UNUSED in self.kind or not normalizer.get(5, 1):
            raise ValueError("only merge-type models with byte fallback, plain pieces and no normalization")
        self.prefix = MARK if normalizer.get(3, 1) else ""
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.byte = {int(self.text[i][3:-1], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.end = self.library.eos_id()
        if any(MARK in t.lstrip(MARK) or "\n" in t or (t.startswith(MARK * 2) and t.strip(MARK)) for t in self.ids):
            raise ValueError("pieces that reach across words or lines")
        runs = {self.score[i] for t, i in self.ids.items() if t.startswith(MARK * 2)}
        others = [self.score[i] for t, i in self.ids.items() if len(t) > 1 and not t.startswith(MARK * 2)]
        if len(set(others)) != len(others) or runs and max(runs) >= min(others):
            raise ValueError("scores that tie within words")
        self.chars = {c for t in self.ids for c in t}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if not t.startswith(MARK * 2) and self.merge(t) == [t]:  # others never come out of merging
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.fits: dict[int, bool] = {}
        self.run_ids: dict[int, tuple[int, ...]] = {}
        self.store = _Store(self)
        self.parts = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+").findall

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, leftmost among equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(parts):
                both = parts[left] + parts[after[left]]
                if both in self.ids:
                    heapq.heappush(queue, (-self.score[self.ids[both]], left, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, left, both = heapq.heappop(queue)
            if parts[left] is None or after[left] >= len(parts) or parts[left] + parts[after[left]] != both:
                continue
            right = after[left]
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def is_fit(self, left: int, right: int) -> bool:
        """Merging the text of two pieces gives the two."""
        known = self.fits.get(left << 20 | right)
        if known is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            a, b = self.text[left], self.text[right]
            known = self.fits[left << 20 | right] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, word: str) -> list[int]:
        """Ids of a word all of whose characters are pieces."""
        length, fits, is_fit = self.length, self.fits, self.is_fit
        matches: list[list[int]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            matches[end - length[piece] + 1].append(piece)
        failed = bytearray(len(word) + 1)
        out: list[int] = []
        tried: list[int] = []  # for each piece of out, how many of its place's matches are left to try
        at, last, size = 0, -1, len(word)
        left = len(matches[0])
        while at < size:
            here = matches[at]
            while left:
                left -= 1
                piece = here[left]
                to = at + length[piece]
                if failed[to]:
                    continue
                if last >= 0:
                    fit = fits.get(last << 20 | piece)
                    if not (is_fit(last, piece) if fit is None else fit):
                        continue
                out.append(piece)
                tried.append(left)
                at, last = to, piece
                left = len(matches[at]) if at < size else 0
                break
            else:
                if not out:
                    raise ValueError(f"no segmentation of {word!r}")
                failed[at] = 1
                at -= length[out.pop()]
                last = out[-1] if out else -1
                left = tried.pop()
        return out

    def run(self, n: int) -> tuple[int, ...]:
        """Ids of a run of word marks."""
        if n not in self.run_ids:
            ids = tuple(self.ids[p] for p in self.merge(MARK * n))
            if n > 256:
                return ids
            self.run_ids[n] = ids
        return self.run_ids[n]

    def encode_part(self, part: str) -> tuple[int, ...]:
        marks = len(part) - len(part.lstrip(MARK))
        word = part[marks - 1 :] if marks else part
        ids: list[int] = []
        known = ""
        if self.chars.issuperset(word):
            ids, word = self.backtrack(word), ""
        for c in word:  # runs of known characters; no piece reaches across the others
            if c in self.chars:
                known += c
                continue
            if known:
                ids += self.backtrack(known)
                known = ""
            ids += [self.byte[b] for b in c.encode()]
        if known:
            ids += self.backtrack(known)
        if marks > 1:  # a mark that its word has left joins the run before it
            alone = self.text[ids[0]] == MARK
            ids = [*self.run(marks if alone else marks - 1), *(ids[1:] if alone else ids)]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text with the end id."""
        if not text:
            return [self.end]
        ids = list(chain.from_iterable(map(self.store.__getitem__, self.parts(self.prefix + text.replace(" ", MARK)))))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def coder(model: bytes) -> Coder:
    key = hashlib.sha256(model).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(model)
    return _coders[key]


def encode(df: DataFrame, model: bytes, text: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of each text, end id included."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(sent.value)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts])

    return df.withColumn(to, run(F.col(text)))


def decode(df: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """``df`` with the text that each list of ids stands for; null ids give the empty text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(sent.value)
        for lists in batches:
            yield pd.Series(c.decode([[] if x is None else [int(i) for i in x] for x in lists]), dtype=object)

    return df.withColumn(to, run(F.col(ids)))


def recode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 (they replace columns of those names).

    Encodes, decodes and takes the digests in one pass, so that ids do not travel back and forth."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    c3 = free_name(df, "codes")

    @F.pandas_udf("n long, i string, d string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(sent.value)
        decimal = [str(i) for i in range(len(c.text))].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts in batches:
            rows = []
            for t in texts:
                ids = c.encode(t)
                rows.append((len(ids), sha(" ".join(map(decimal, ids))), sha(c.library.decode(ids))))
            yield pd.DataFrame(rows, columns=["n", "i", "d"])

    return df.withColumn(c3, run(F.col(text))).withColumns({"n_tokens": F.col(f"{c3}.n"), "ids_sha256": F.col(f"{c3}.i"), "decoded_sha256": F.col(f"{c3}.d")}).drop(c3)


def op6_piece_codec(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recode(docs, model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op6_piece_codec": op6_piece_codec}
SQL: dict[str, str] = {}
