"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising is one narrow scan. Lengths are whole numbers up to the capacity, so documents and gaps,
sorted by size, are runs of equal size: at most ``capacity`` of each, whatever the number of
documents. Matching is one sequential loop on the driver over the counts of these runs, in place
of bulk-synchronous rounds of distributed sweeps: each run of documents, longest first, is
matched to its successor, the run of the smallest gaps that hold it; within a run the rank decides
who gets which gap; the gaps shrink; and the step repeats until the run is placed, opening new
sequences where no gap holds it. A step yields one record (length, first rank, count, first
sequence, offset). Ranks of documents within a length come from a distributed count by (length,
bucket), so a length that a third of all documents share is ranked by many tasks, and one join
with the records places every row: broadcast up to ``BROADCAST_ROWS`` records, shuffled beyond.

Defined results: a null or empty text has only the end token; longer documents are cut into full
pieces after a shorter first one; repeated rows are packed each; an empty table gives an empty
result; other columns are neither read nor changed.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.llm.tables import BROADCAST_ROWS, kept

CAPACITY, END = 2048, 0
#: Rows that one bucket of a length is expected to hold; distinct units that a worker remembers.
BUCKET_ROWS, REMEMBERED = 200_000, 200_000
SPECIAL = "<|endoftext|>"


WHITE = [chr(point) for point in range(0x3001) if chr(point).isspace()]


class Tokens:
    """Token ids of texts, with the units of text remembered.

    A single space between two other characters that are not white space always begins a new
    unit of the tokenizer's pattern, so a text can be cut there and units be looked up. Units not
    seen yet are encoded together: a unit holds one space, its first character, so the ids of a
    unit begin at a token with a leading space. Texts with any other spacing are encoded whole.
    The ids are those of the tokenizer's JSON file.
    """

    def __init__(self, vocabulary: str, pattern: str, special: int):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special})
        self.opens = np.zeros(max(ranks.values()) + 2, bool)
        self.opens[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.asarray(self.encoder.encode(text, allowed_special="all"), "<u4")
        return np.asarray(self.encoder.encode_ordinary(text), "<u4")

    def learn(self, units: list[str]) -> None:
        for low in range(0, len(units), 20_000):
            some = units[low : low + 20_000]
            ids = self.ids(" " + " ".join(some))
            starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            data = ids.tobytes()
            self.known.update(zip(some, map(data.__getitem__, map(slice, starts, [*starts[1:], len(data)])), strict=True))

    @staticmethod
    def plain(text: str) -> bool:
        if SPECIAL in text or text[0] == " " or text[-1] == " ":
            return False
        return not any(w in text and (w + " " in text or " " + w in text) for w in WHITE)

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [text.split(" ") if text and self.plain(text) else None for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        units = set(chain.from_iterable(units[1:] for units in cut if units))
        self.learn([unit for unit in units if unit not in self.known])
        find = self.known.__getitem__
        out = []
        for text, units in zip(texts, cut, strict=True):
            if units:
                out.append(b"".join([self.ids(units[0]).tobytes(), *map(find, units[1:])]))
            else:
                out.append(self.ids(text).tobytes() if text else b"")
        return out


_tokens: dict[str, Tokens] = {}


def _tokens_of(vocabulary: str) -> Tokens:
    if vocabulary not in _tokens:
        from public_tokenizers import PATTERN

        _tokens[vocabulary] = Tokens(vocabulary, PATTERN, 50256)
    return _tokens[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids``; ids are little-endian unsigned 32-bit numbers.

    ``vocabulary`` is a file of byte-level BPE ranks that every executor has at this path.
    """
    last = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens_of(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                keys, number, starts, sizes, ids = [], [], [], [], []
                texts = tokens.of(part.column("text").to_pylist())
                for key, data in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    data += last
                    total = len(data) // 4
                    at, piece, size = 0, 0, total % capacity or capacity
                    while at < total:
                        keys.append(key)
                        number.append(piece)
                        starts.append(at)
                        sizes.append(size)
                        ids.append(data[4 * at : 4 * (at + size)])
                        at, piece, size = at + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def placements(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Records (length, first rank, count, first sequence, offset) for ``counts`` of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened, out = 0, []

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                new = -(-left // (capacity // length))
                free(capacity, opened, new)
                opened += new
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            used = min(count, -(-left // (gap // length)))
            out.append((length, rank, used, first, capacity - gap))
            free(gap, first + used, count - used)
            free(gap - length, first, used)
            rank, left = rank + used, left - used
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length``) and ``sequence_id`` and ``offset``; they are written once."""
    spark = rows.sparkSession
    table = kept(rows.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    buckets = max(1, table.count() // BUCKET_ROWS)
    table = table.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    parts = kept(table.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")), "length-counts")
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = placements(counts, capacity)
    records = spark.createDataFrame(found, "__length long, __rank long, __count long, __first long, offset long")
    records = F.broadcast(records) if len(found) <= BROADCAST_ROWS else records.hint("merge")
    own = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("__row")) - 1
    ranked = table.withColumn("__own", own).join(parts, ["length", "__bucket"])
    ranked = ranked.withColumn("__at", F.col("__own") + F.col("__before"))
    inside = (F.col("length") == F.col("__length")) & (F.col("__at") >= F.col("__rank")) & (F.col("__at") < F.col("__rank") + F.col("__count"))
    placed = ranked.join(records, inside)
    sequence = (F.col("__first") + F.col("__at") - F.col("__rank")).alias("sequence_id")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], sequence, "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of whole sequences, for rows that still carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return joined.select("sequence_id", "length", ids.alias("ids"))
