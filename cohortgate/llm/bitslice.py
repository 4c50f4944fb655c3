"""Exact top-k inner products over a bit-sliced index.

Components are quantised to whole numbers. A block of rows is stored by attribute and bit: slice
(d, b) is a bitmap over the rows that holds bit b of attribute d, counted from the block's least
value. For a query, attribute d contributes its slices shifted by the set bits of the query's
component (complemented where that is negative); the bitmaps of each binary place are added by
carry-save adders, which leaves the scores of all rows as slices. The k best rows are then selected
from the most significant slice downward, and rows that tie at the boundary are resolved by id.
Scores are exact, so nothing has to be verified.

Every row is indexed once, in blocks of bounded size. Queries are the stated set; each group of
queries of bounded size meets each block once, which gives at most k rows per query and block, and
a ranked window over these gives the answer.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different lengths do not meet; a component whose quantised value does not fit a long, or an
answer whose score does not, stops the job, since no right long exists for it; rows with the query's own id are not its candidates; repeated query rows
are answered once; null ids take no part. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.llm.tables import kept

#: Rows of a block of the index, and queries of a group.
BLOCK_ROWS, GROUP_QUERIES = 32_768, 512


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of each component, rows that take part only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)

    def one(x: Column) -> Column:
        scaled = x.cast("double") * scale
        wide = F.raise_error(F.lit("a quantised component does not fit a long")).cast("long")
        return F.when(F.abs(scaled) < float(1 << 63), F.floor(scaled).cast("long")).otherwise(wide)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", one).alias("q"))


class SlicedBlock:
    """Slices of some rows: ids ascending, least values, and bitmaps attribute by attribute."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.bits, self.slices = ids, low, bits, slices
        self.begin = np.concatenate([[0], np.cumsum(bits)])
        self.flipped = ~slices

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order].astype(np.int64)
        low = values.min(axis=0)
        above = values.astype(np.uint64) - low.astype(np.uint64)  # right also where the span passes 2**63
        bits = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int32)
        words = -(-len(ids) // 64)
        rows = []
        for d, count in enumerate(bits):
            for b in range(count):
                packed = np.zeros(words * 8, np.uint8)
                on = np.packbits(((above[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
                packed[: len(on)] = on
                rows.append(packed.view(np.uint64))
        return cls(ids, low, bits, np.array(rows, np.uint64).reshape(len(rows), words))

    def scores(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """A constant, and the slices (least significant first) that are to be added to it."""
        constant = sum(map(int.__mul__, query.tolist(), self.low.tolist()))
        places: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            source = self.slices
            if q < 0:  # q * v = |q| * (top - v) - |q| * top
                constant += q * ((1 << int(self.bits[d])) - 1)
                source, q = self.flipped, -q
            for e in range(q.bit_length()):
                if q >> e & 1:
                    for b in range(int(self.bits[d])):
                        while len(places) <= e + b:
                            places.append([])
                        places[e + b].append(source[self.begin[d] + b])
        out, p = [], 0
        while p < len(places):
            column = places[p]
            while len(column) > 1:
                x, y = column.pop(), column.pop()
                half = x ^ y
                if column:
                    z = column.pop()
                    total, carry = half ^ z, (x & y) | (half & z)
                else:
                    total, carry = half, x & y
                column.insert(0, total)
                if p + 1 == len(places):
                    places.append([])
                places[p + 1].append(carry)
            out.append(column[0] if column else np.zeros(self.slices.shape[1], np.uint64))
            p += 1
        return constant, out

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), ties to smaller ids, without rows of the id ``own``."""
        rows, words = len(self.ids), -(-len(self.ids) // 64)
        tied = np.full(words, ~np.uint64(0))
        if rows % 64:
            tied[-1] = np.uint64((1 << rows % 64) - 1)
        low, high = np.searchsorted(self.ids, [own, own + 1])
        for at in range(low, high):
            tied[at // 64] &= ~np.uint64(1 << (at % 64))
        constant, slices = self.scores(query)
        sure = np.zeros(words, np.uint64)
        for piece in reversed(slices):
            both = tied & piece
            reached = sure | both
            count = int(np.bitwise_count(reached).sum())
            if count > k:
                tied = both
            else:
                sure = reached
                tied &= ~piece
                if count == k:
                    tied[:] = 0
                    break
        chosen = _places(sure)
        chosen = np.concatenate([chosen, _places(tied)[: k - len(chosen)]])  # ids ascend with places
        word, bit = chosen // 64, (chosen % 64).astype(np.uint64)
        score = [constant + sum(int(s[w] >> b & np.uint64(1)) << p for p, s in enumerate(slices)) for w, b in zip(word, bit, strict=True)]
        best = sorted(zip(self.ids[chosen].tolist(), score, strict=True), key=lambda r: (-r[1], r[0]))
        return best[:k]


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


INDEX = "dims int, block long, ids binary, low binary, bits binary, slices binary"


def index_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of ``rows`` (``vec_id, q``), one row per block, written once."""
    parts = max(1, math.ceil(rows.count() / block_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([a for a, _ in held[dims]])
            made = SlicedBlock.of(ids, np.concatenate([b for _, b in held.pop(dims)]))
            data = [made.ids.tobytes(), made.low.tobytes(), made.bits.tobytes(), made.slices.tobytes()]
            size[dims] = 0
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["dims", "ids", "low", "bits", "slices"])

        for batch in batches:
            lengths = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = batch.column("q").flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                values = flat[begin[at][:, None] + np.arange(dims)]
                for low in range(0, len(at), block_rows):
                    held.setdefault(dims, []).append((ids[at[low : low + block_rows]], values[low : low + block_rows]))
                    size[dims] = size.get(dims, 0) + len(at[low : low + block_rows])
                    if size[dims] >= block_rows:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    made = rows.repartition(parts).mapInArrow(build, INDEX.replace("block long, ", ""))
    return kept(made.withColumn("block", F.monotonically_increasing_id()), "sliced-index")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` where ``is_query`` holds."""
    rows = quantised(vectors, scale)
    index = index_of(rows, block_rows)
    queries = kept(quantised(vectors.filter(is_query), scale).distinct(), "queries")
    groups = max(1, math.ceil(queries.count() / GROUP_QUERIES))
    asked = queries.select(F.size("q").alias("dims"), "vec_id", "q", F.xxhash64("q").alias("key"))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "key"), F.lit(groups)))
    pairs = kept(index.select("dims", "block").join(asked.select("dims", "group").distinct(), "dims"), "block-groups")
    blocks = index.join(pairs, ["dims", "block"])
    lists = asked.join(pairs, ["dims", "group"]).select("vec_id", "q", "key", *[F.col(c).alias(f"ask_{c}") for c in ("block", "group", "dims")])

    def search(key: tuple, block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(ask):
            dims, one = int(key[2]), block.iloc[0]
            ids = np.frombuffer(one["ids"], np.int64)
            words = -(-len(ids) // 64)
            made = SlicedBlock(ids, np.frombuffer(one["low"], np.int64), np.frombuffer(one["bits"], np.int32), np.frombuffer(one["slices"], np.uint64).reshape(-1, words))
            for own, tag, q in zip(ask["vec_id"], ask["key"], ask["q"], strict=True):
                query = np.asarray(q, np.int64).reshape(dims)
                found = made.top(int(own), query, k)
                if any(not -(1 << 63) <= score < 1 << 63 for _, score in found):
                    raise OverflowError("a score does not fit a long")
                out += [(own, tag, vec, score) for vec, score in found]
        return pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"]).astype("int64")

    found = blocks.groupBy("block", "group", "dims").cogroup(lists.groupBy("ask_block", "ask_group", "ask_dims")).applyInPandas(
        search, "query_id long, key long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
