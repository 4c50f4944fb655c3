"""Ranked lexical search by NRA: sorted reads only, score intervals, no lookups of single documents.

Documents are split over tasks (a document-partitioned index), so the list of a very common term is
spread over all of them and no term, and no document, gathers in one place.

1. One narrow scan turns every text into its length and its query terms with their frequencies, and
   is written once. Only terms that some query holds are listed.
2. Document frequencies are counted over all documents; with them every posting has its impact, the
   share of a score that it brings.
3. Each task takes its documents in blocks of bounded postings, sorts the list of each term by falling
   impact, and reads the lists of a query from the front, in rounds that reach four times deeper each.
   A document's lower bound is the sum of the impacts read; its upper bound adds, for every list in
   which it was not met, the impact at which that list stands. A round drops documents whose upper
   bound is below the k-th lower bound, also of earlier blocks of the task; equal ones stay, since ids
   decide ties. Reading ends when the interval of every document left is one point, so membership,
   ties and scores are all resolved by sequential reads.
4. The k best of each task are ranked by query. That is all that is shuffled.

Queries are taken in blocks by the bytes of their texts, so what a task holds of them is bounded.

Defined results: a null or empty text, and one without a term, has no terms and is never ranked;
documents with a null id count like others and come last among equal scores; every row of the
documents and every row of the queries stands for itself, also when it is repeated or its id is null;
scores of 0 are left out; an empty table gives an empty result. A text of any length is one row; its
words are in memory one text at a time. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.llm.batches import by_bytes
from cohortgate.llm.tables import kept

#: Bytes of query texts that are answered by one pass over the documents; a longer query is alone in a pass.
QUERY_BYTES = 2 << 20
#: Postings that a task sorts at once.
BLOCK_POSTINGS = 1 << 21
#: Postings of each list read in the first round, and how much deeper the next one goes.
FIRST_DEPTH, DEEPER = 64, 4

_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms(data: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lowered."""
    return data.translate(_FOLD).split() if data else []


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term of weight 1 brings to documents of ``n`` terms that hold it ``tf`` times."""
    if 90 * int(n.max(initial=0)) * documents >= 1 << 63:
        relative = np.array([90 * int(x) * documents // total for x in n], np.int64)
    else:
        relative = 90 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + relative))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document; terms are numbers of ``vocabulary``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for part in by_bytes(batches):
            sizes, ends, found, times = [], [0], [], []
            for data in part.column("text").to_pylist():
                words = terms(data)
                counted = Counter(map(find, words))
                counted.pop(None, None)
                sizes.append(len(words))
                found.extend(counted.keys())
                times.extend(counted.values())
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (found, times)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>")


def resolved(lists: Sequence[tuple[np.ndarray, np.ndarray]], size: int, floor: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below ``size``) that may be among the k best, and their exact scores.

    ``lists`` hold documents and impacts by falling impact; ``floor`` are k-best scores known already.
    """
    lower, met = np.zeros(size, np.int64), np.zeros(size, np.int64)
    fronts = [int(impact[0]) for _, impact in lists]
    ends = [0] * len(lists)
    known = np.asarray(floor, np.int64)
    depth = FIRST_DEPTH
    while True:
        for at, (docs, impact) in enumerate(lists):
            begin, end = ends[at], min(depth, len(docs))
            if begin == end:
                continue
            front = int(impact[end]) if end < len(docs) else 0
            met[docs[:begin]] += front - fronts[at]
            met[docs[begin:end]] += front
            lower[docs[begin:end]] += impact[begin:end]
            fronts[at], ends[at] = front, end
        upper = lower + (sum(fronts) - met)
        scores = np.concatenate([lower, known])
        bar = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
        left = np.flatnonzero(upper >= max(bar, 1))
        if (upper[left] == lower[left]).all():
            return left, lower[left]
        depth *= DEEPER


class _Search:
    """The k best documents so far of every query, over the blocks of one task."""

    def __init__(self, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int):
        self.queries, self.weights, self.documents, self.total, self.k = queries, weights, documents, total, k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]

    def add(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        ids = table.column("doc_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = table.column("terms").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        found = lists.flatten().to_numpy(zero_copy_only=False)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.repeat(table.column("n").to_numpy(), counts)
        impact = self.weights[found] * impacts(tf, n, self.documents, self.total)
        good = impact > 0
        found, impact, docs = found[good], impact[good], np.repeat(place, counts)[good]
        by_list = np.lexsort((-impact, found))
        found, impact, docs = found[by_list], impact[by_list], docs[by_list]
        bounds = np.searchsorted(found, np.arange(len(self.weights) + 1))
        for at, (_, wanted) in enumerate(self.queries):
            spans = [(int(bounds[t]), int(bounds[t + 1])) for t in wanted]
            read = [(docs[low:high], impact[low:high]) for low, high in spans if high > low]
            if not read:
                continue
            left, scores = resolved(read, len(order), [-s for s, _, _ in self.best[at]], self.k)
            front = np.lexsort((left, -scores))[: self.k]
            rows = order[left[front]]
            new = [(-int(s), bool(null[r]), int(ids[r])) for s, r in zip(scores[front], rows, strict=True)]
            self.best[at] = sorted(self.best[at] + new)[: self.k]

    def rows(self) -> pa.RecordBatch:
        flat = [(key, None if gone else doc, -s) for (key, _), best in zip(self.queries, self.best, strict=True) for s, gone, doc in best]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])


def _answers(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """``query, doc_id, score``: the k best of each task."""
    vocabulary: dict[bytes, int] = {}
    wanted = [(key, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in words], np.int64)) for key, words in queries]
    index = kept(postings(docs, vocabulary), "postings")
    whole = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in counted:
        weights[row.term] = weight(whole.documents, row.df)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Search(wanted, weights, whole.documents, whole.total, k)
        parts, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                parts.append(part)
                size += len(part.column("terms").flatten())
                if size >= BLOCK_POSTINGS:
                    state.add(parts)
                    parts, size = [], 0
        if parts:
            state.add(parts)
        yield state.rows()

    return index.filter(F.size("terms") > 0).mapInArrow(search, "query long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id, text``) for each row of
    ``items`` (``item_id, text``)."""
    keyed = kept(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("query")), "queries")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // QUERY_BYTES
    found = []
    for block in range(blocks):
        own = keyed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", F.col("text").cast("binary").alias("text"))
        queries = [(row.query, sorted(set(terms(bytes(row.text or b""))))) for row in own.collect()]
        answers = _answers(docs, queries, k)
        found.append(kept(answers, "answers") if blocks > 1 else answers)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(keyed.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
