"""Byte-level BPE by prefix dynamic programming, and decoding.

Merging a string of bytes by ranks leaves one token at its end. That token is stored for every prefix:
it is the only one that ends there, fits what the prefix before it ends in, and would not be merged
with it otherwise. Two neighbours fit when merging their bytes alone gives just these two; a whole
encoding is right exactly when all its neighbours fit, so looking one token back is enough. The tokens
of a string are read off from its end. The table makes two things exact and cheap:

- *append*: entries of the old prefix stay, new ones are added;
- *edit*: entries before the edit stay, and as soon as as many entries as the longest token has bytes
  agree with the old ones behind it, all later ones do.

Texts are split by the vocabulary's pattern first and every match is encoded by itself; a match that
is a token is that token. Matches met before are remembered, up to a bound. ``revised`` carries an edit
over to a text that is encoded already: only what lies between two sure borders of matches around
the edit is split and encoded again.

Defined results: null counts as an empty text, which has no tokens; a text of any length is encoded
whole, in memory one text at a time and without recursion; rows with a null id or repeated rows are
encoded each; an empty table gives an empty result; other columns are neither read nor changed.
Strings of special tokens are ordinary text. The vocabulary must hold all 256 bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.batches import by_bytes

#: Matches, and pairs of neighbours, that a worker remembers.
REMEMBERED, PAIRS = 400_000, 1_000_000


class Vocabulary:
    """Ranks of byte strings: which neighbours fit, and the tokens that end at each byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.endings.add_word(token.decode("latin-1"), rank)
        self.endings.make_automaton()
        self.sizes = [len(token) for token in self.tokens]
        self.longest = max(self.sizes)
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, for the few bytes of two neighbours."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == len(self.tokens):
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int | None, token: int) -> bool:
        """Whether ``token`` stays as it is behind ``before`` (None: at the beginning)."""
        key = -1 - token if before is None else before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            wanted = [self.tokens[token]] if before is None else [self.tokens[before], self.tokens[token]]
            known = self.pairs[key] = self.merged(b"".join(wanted)) == wanted
        return known


class PrefixTable:
    """The last token of every prefix of one string of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, data: bytes, old: list[int] | None = None, sure: int = 0) -> None:
        """Fill in the entries of ``data`` behind those there are.

        ``old`` are the entries of another string that ends in the same bytes from ``sure`` on.
        """
        words, last, size = self.vocabulary, self.last, self.vocabulary.sizes
        filled = len(last) - 1
        base = max(0, filled + 1 - words.longest)
        last.extend([-1] * (len(data) - filled))
        shift = 0 if old is None else len(old) - len(last)
        agreed, before = 0, filled
        for place, token in words.endings.iter(data[base:].decode("latin-1")):
            end = base + place + 1
            if end <= filled or last[end] >= 0:
                continue
            if old is not None and end != before:
                agreed = agreed + 1 if before >= sure and before > filled and last[before] == old[before + shift] else 0
                if agreed >= words.longest:
                    last[end:] = old[end + shift :]
                    break
                before = end
            begin = end - size[token]
            if (begin == 0 or last[begin] >= 0) and words.fits(last[begin] if begin else None, token):
                last[end] = token
        self.data = data

    def append(self, data: bytes) -> None:
        self._extend(self.data + data)

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Replace the bytes from ``start`` to ``stop``."""
        old = self.last
        self.last = old[: start + 1]
        self._extend(self.data[:start] + data + self.data[stop:], old, start + len(data) + self.vocabulary.longest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(token)
            end -= self.vocabulary.sizes[token]
        return out[::-1]


class Encoder:
    """Ids of texts by a vocabulary and the pattern that splits them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        data = match.encode("utf-8")
        rank = self.vocabulary.ranks.get(data)
        ids = [rank] if rank is not None else PrefixTable(self.vocabulary, data).ids()
        return np.asarray(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        matches = self.pattern.findall(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for match in set(matches).difference(known):
            known[match] = self._match(match)
        return b"".join(map(known.__getitem__, matches))

    def text(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    #: Before a single space between two characters that are not white space a match always begins.
    _BORDER = regex.compile(r"(?<=\S) (?=\S)")

    def revised(self, text: str, ids: bytes, start: int, stop: int, new: str) -> tuple[str, bytes]:
        """The text with ``new`` in place of characters ``start`` to ``stop``, and its ids."""
        changed = text[:start] + new + text[stop:]
        low = 0
        for found in self._BORDER.finditer(text[:start], max(0, start - 4096)):
            low = found.start()
        right = self._BORDER.search(changed, start + len(new) + 1)
        high = right.start() if right else len(changed)
        ends = np.cumsum([0, *map(self.vocabulary.sizes.__getitem__, np.frombuffer(ids, "<u4").tolist())])
        left_ids = int(np.searchsorted(ends, len(text[:low].encode("utf-8"))))
        right_ids = int(np.searchsorted(ends, int(ends[-1]) - len(changed[high:].encode("utf-8"))))
        return changed, ids[: 4 * left_ids] + self.ids(changed[low:high]) + ids[4 * right_ids :]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """The encoder of this worker for a rank file, which every executor has at this path."""
    if (vocabulary, pattern) not in _encoders:
        _encoders[vocabulary, pattern] = Encoder(Vocabulary.read(vocabulary), pattern)
    return _encoders[vocabulary, pattern]


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: the ids of its text, and the bytes these ids stand for."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for part in by_bytes(batches):
            ids = [coder.ids(text) if text else b"" for text in part.column("text").to_pylist()]
            decoded = [coder.text(data) for data in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return _keyed(docs.withColumn("text", F.col("text").cast("string")), "text").mapInArrow(encode, "doc_id long, ids binary, decoded binary")


def decoded(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``; null ids stand for no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for part in by_bytes(batches, "ids"):
            texts = [coder.text(data or b"") for data in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return _keyed(rows, "ids").mapInArrow(decode, "doc_id long, decoded binary")


def revised(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, text, ids`` after an edit of encoded texts: ``doc_id, text, ids, start, stop, new``.

    Characters ``start`` to ``stop`` become ``new``; positions beyond the text are taken as its end,
    and a null anywhere in the edit leaves the row as it is.
    """

    def revise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for part in by_bytes(batches):
            texts, ids = [], []
            for row in part.to_pylist():
                text, data = row["text"] or "", row["ids"] or b""
                if None not in (row["start"], row["stop"], row["new"]):
                    start = min(max(0, row["start"]), len(text))
                    stop = min(max(start, row["stop"]), len(text))
                    text, data = coder.revised(text, data, start, stop, row["new"])
                texts.append(text)
                ids.append(data)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"]
            )

    return _keyed(rows, "text", "ids", "start", "stop", "new").mapInArrow(revise, "doc_id long, text string, ids binary")
