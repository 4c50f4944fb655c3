"""Removal of repeated byte strings by content-triggered parsing.

A rolling hash of ``TRIGGER`` bytes sets the triggers: the least hash of every window of ``SPAN``
places. They cut each text into phrases in the same way wherever the same bytes stand. Every string
of ``LENGTH`` bytes belongs to one trigger, the least of its first ``SPAN`` places, so equal strings
belong to equal triggers at the same distance, and the strings of one trigger start in one run of
places. The parse is the table of triggers with two names: of the ``CONTEXT`` bytes that all its
strings share (the phrases that follow), and of its whole surroundings, from the first string's
start to the last one's end. Names are 64-bit digests, used together as 128.

The order of suffixes is needed only down to ``LENGTH`` bytes and only for equality, so names take
the place of ranks: a trigger whose following bytes occur once is settled; one whose whole
surroundings occur twice is covered; only what lies between, at the edges of repeated passages, is
looked at string by string. Those surroundings are dealt by the name of the following bytes, so
each task has all equal strings; a name with more than ``HOT`` surroundings is dealt string by
string instead. The corpus is never gathered, and text is shuffled twice.

Defined results: texts are UTF-8 bytes, null counts as empty, and matches never cross documents;
texts shorter than ``LENGTH`` stay whole; repeated rows are copies of each other, so long ones go
entirely; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.shingles import mix
from cohortgate.llm.tables import kept

LENGTH, SPAN, TRIGGER = 400, 256, 16
#: Surroundings that one task compares on average, and those of one name from which strings are
#: dealt out instead: 32,768 surroundings of some 60 strings each take a task about 150 MB.
TASK_ROWS, HOT = 20_000, 32_768
#: Places that are parsed together; longer texts are parsed piece by piece.
PIECE = 4_000_000
_PRIME = 0x9E3779B97F4A7C15
_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in (_PRIME, 0xD1B54A32D192ED03)]
_PLACE = np.uint64((1 << 24) - 1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            steps = np.full(max(2 * n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Hashed:
    """Digests of any substring of some bytes, by running sums."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        up, self.down = powers(self.n + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: self.n])]) for values in _VALUES]

    def of(self, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        return mix((sums[high] - sums[low]) * self.down[low])


def triggers(hashed: Hashed, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings of each trigger, and the trigger's place."""
    windows = hashed.n - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    places = np.arange(windows + span - 1)
    keys = (hashed.of(places, places + TRIGGER) & ~_PLACE) | places.astype(np.uint64)
    blocks = -(-len(keys) // span)
    rows = np.concatenate([keys, np.full(blocks * span - len(keys), _FULL)]).reshape(blocks, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[span - 1 : span - 1 + windows]
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    least = (np.minimum(behind, ahead) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.concatenate([first[1:], [windows]]) - 1, least[first]


def names(data: bytes, length: int, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``first, last, following, around`` of the triggers of a text, piece by piece."""
    for base in range(0, max(1, len(data) - length + 1), PIECE):
        hashed = Hashed(data[base : base + PIECE + length - 1])
        first, last, at = triggers(hashed, length, span)
        around = mix(hashed.of(first, last + length, 1) ^ ((at - first) * 65536 + last - at + 32768).astype(np.uint64))
        yield first + base, last + base, hashed.of(at, at + length - span + 1), around


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def parse(rows: DataFrame, length: int, span: int) -> DataFrame:
    """``doc_id, text_hash, low, high, following, around``: the strings start from low to high."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found, owner = [], []
                    for row, text in enumerate(part.column("text").to_pylist()):
                        for piece in names(text.encode("utf-8", "surrogatepass"), length, span):
                            found.append(piece)
                            owner.append(np.full(len(piece[0]), row))
                    low, high, following, around = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
                    of = pa.array(np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(of), part.column("text_hash").take(of), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(following.astype(np.uint64).view(np.int64)), pa.array(around.astype(np.uint64).view(np.int64))],
                        names=["doc_id", "text_hash", "low", "high", "following", "around"],
                    )

    return rows.mapInArrow(cut, "doc_id long, text_hash long, low long, high long, following long, around long")


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place within it and the two digests of every string of ``length`` bytes in ``bytes``."""
    data = batch.column("bytes").to_pylist()
    sizes = np.array([len(d) for d in data], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(data)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashed = Hashed(b"".join(data))
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + place
    return row, place, hashed.of(start, start + length), hashed.of(start, start + length, 1)


def _extent(row: np.ndarray, place: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    np.minimum.at(low, row, place)
    np.maximum.at(high, row, place)
    return low, high


AROUND = "doc_id long, text_hash long, low long, lone boolean, following long, bytes binary"


def _surroundings(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes about the triggers of ``wanted``, from their texts."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high", "lone", "following")).alias("spots"))
    lists = lists.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spots")
    met = rows.join(lists, rows["doc_id"].eqNullSafe(lists["id"]) & (rows["text_hash"] == lists["hash"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: dict[str, list] = {n: [] for n in ("doc_id", "text_hash", "low", "lone", "following", "bytes")}
                for row in batch.slice(at, 256).to_pylist():
                    data = row["text"].encode("utf-8", "surrogatepass")
                    for spot in {tuple(s.items()): s for s in row["spots"]}.values():
                        for n in ("doc_id", "text_hash"):
                            out[n].append(row[n])
                        for n in ("low", "lone", "following"):
                            out[n].append(spot[n])
                        out["bytes"].append(data[spot["low"] : spot["high"] + length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["text_hash"], pa.int64()), pa.array(out["low"], pa.int64()), pa.array(out["lone"], pa.bool_()), pa.array(out["following"], pa.int64()), pa.array(out["bytes"], pa.binary())],
                    names=list(out),
                )

    return met.select("doc_id", "text_hash", "text", "spots").mapInArrow(cut, AROUND)


def _met_in_tasks(around: DataFrame, parts: int, length: int) -> DataFrame:
    """Covered stretches of lone surroundings; equal strings are in the same task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held, keys = [], []
            for batch in batches:
                row, place, one, two = _windows(batch, length)
                held.append((row + sum(map(len, keys)), place, one, two))
                keys.append(batch.drop_columns(["bytes", "following"]))
            if not keys:
                return
            row, place, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            met = np.zeros(len(row), bool)
            met[order[1:]] |= same
            met[order[:-1]] |= same
            low, high = _extent(row[met], place[met], sum(map(len, keys)))
            table = pa.Table.from_batches(keys)
            begin = table.column("low").to_numpy()
            good = (high >= 0) & table.column("lone").to_numpy()
            out = table.select(["doc_id", "text_hash"]).append_column("begin", pa.array(begin + np.where(good, low, 0))).append_column("stop", pa.array(begin + high + length))
            yield from out.filter(pa.array(good)).to_batches()

    return around.repartition(parts, "following").mapInArrow(compare, "doc_id long, text_hash long, begin long, stop long")


def _met_by_string(around: DataFrame, length: int) -> DataFrame:
    """The same, with every string a row of its own."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    row, place, one, two = _windows(part, length)
                    of = pa.array(row)
                    low = part.column("low").take(of).to_numpy() + place
                    yield pa.RecordBatch.from_arrays(
                        [part.column(n).take(of) for n in ("doc_id", "text_hash", "low", "lone")] + [pa.array(low), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                        names=["doc_id", "text_hash", "low", "lone", "start", "one", "two"],
                    )

    strings = around.mapInArrow(spread, "doc_id long, text_hash long, low long, lone boolean, start long, one long, two long")
    again = kept(strings.groupBy("one", "two").count().filter("count > 1").select("one", "two"), "repeated-strings")
    met = strings.filter("lone").join(again, ["one", "two"])
    return met.groupBy("doc_id", "text_hash", "low").agg(F.min("start").alias("begin"), (F.max("start") + length).alias("stop")).drop("low")


def repeated_stretches(docs: DataFrame, length: int = LENGTH, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """``doc_id, text_hash, begin, stop``: bytes covered by strings that also start elsewhere."""
    rows = _rows(docs)
    parsed = parse(rows, length, span)
    classes = kept(parsed.groupBy("following", "around").count(), "trigger-names")
    groups = classes.groupBy("following").agg(F.sum("count").alias("total"), F.min("count").alias("least"))
    groups = kept(groups.filter("total > 1"), "following-names")
    status = kept(
        classes.join(groups, "following").select("following", "around", (F.col("count") == 1).alias("lone"), (F.col("least") == 1).alias("open")),
        "status",
    )
    spots = kept(parsed.join(status, ["following", "around"]), "spots")
    whole = spots.filter("not lone").select("doc_id", "text_hash", F.col("low").alias("begin"), (F.col("high") + length).alias("stop"))
    stand_in = spots.filter("open and not lone").groupBy("following", "around").agg(F.min(F.struct("doc_id", "text_hash", "low", "high")).alias("one"))
    fields = ["doc_id", "text_hash", "low", "high"]
    wanted = spots.filter("lone").select(*fields, "lone", "following").unionByName(
        stand_in.select(*[F.col(f"one.{c}").alias(c) for c in fields], F.lit(False).alias("lone"), "following")
    )
    crowds = kept(wanted.groupBy("following").count().filter(F.col("count") > hot).select("following"), "hot-names")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(status.count() / TASK_ROWS))
    out = whole.unionByName(_met_in_tasks(_surroundings(rows, wanted.join(crowds, "following", "left_anti"), length), tasks, length))
    if not crowds.isEmpty():
        out = out.unionByName(_met_by_string(kept(_surroundings(rows, wanted.join(crowds, "following", "left_semi"), length), "hot-surroundings"), length))
    return kept(out, "stretches")


def without_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, kept_text (bytes), removed``: removed are the maximal runs that went."""
    rows = _rows(docs)
    found = repeated_stretches(docs, length, span, hot).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "stop")).alias("runs"))
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "runs")
    met = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["text_hash"] == found["hash"]), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, kept_bytes, removed = [], [], []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    gone: list[list[int]] = []
                    for run in sorted((r["begin"], r["stop"]) for r in runs or ()):
                        if gone and run[0] <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], run[1])
                        else:
                            gone.append(list(run))
                    edges = [0, *(x for run in gone for x in run), len(data)]
                    sizes.append(len(data))
                    kept_bytes.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"begin": a, "stop": b} for a, b in gone])
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept_bytes, pa.binary()), pa.array(removed, kind)],
                    names=["doc_id", "n_bytes", "kept_text", "removed"],
                )

    return met.select("doc_id", "text", "runs").mapInArrow(
        remove, "doc_id long, n_bytes long, kept_text binary, removed array<struct<begin:long,stop:long>>"
    )
