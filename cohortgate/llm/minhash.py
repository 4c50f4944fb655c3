"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i every shingle is hashed to one bin with the value
(i, hash), and a bin keeps its least value; from round ``BINS`` on, round ``BINS`` + j sends every
shingle to bin j. So every coordinate fills after at most twice ``BINS`` rounds (usually one or
two), and the share of equal coordinates concentrates about the similarity as for independent
ones. Bands of equal rows give candidates. Their rows follow from the similarity asked for, so that
a pair at it meets in no band with a probability below ``BAND_MISS`` (four rows at 0.8, fewer below,
and one group of all sets below about 0.12, where no band is sure enough).

Documents with the same set form a class and only its first one goes on. In a band's group every
class is compared with the group's hub, the least by hash, so a group of thousands of near copies
makes as many pairs, not their square. Only pairs whose sketches agree are confirmed on full sets; links are joined to components.
Classes that share a band but not a component meet other hubs of the group. In the end all that are
still apart are compared inside the tasks, block by block: by sketch, then by a sketch of four times
as many coordinates and on full sets, which only classes with a possible partner are sent with. A pair
that shares several bands is compared in the first of them only. A task joins what it finds and hands on a spanning forest, so no more rows leave it than classes
came in, however many documents share a passage. Texts of classes that share a band are taken out
once, and no pair of texts is in memory but in slices of bounded bytes.

Defined results: a null text or one without a word has an empty set and is linked with nothing; a
text with fewer words than a shingle has its whole sequence as its one shingle; a null id is
ignored in the smallest id of a component; of a component without any id, and of rows that share the
smallest one, one row is kept (the least by text hash), and of repeated rows one; an empty table gives
an empty result; a very long text is hashed by itself; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.batches import by_bytes
from cohortgate.llm.components import components
from cohortgate.llm.shingles import mix, shingle_sets
from cohortgate.llm.tables import kept

BINS, LONG_BINS = 128, 512
#: Bounds of the probability that a pair at the similarity asked for shares no band, and that its
#: sketches agree too little.
BAND_MISS, AGREE_MISS = 1e-7, 1e-8
#: Rounds of further hubs before all remaining pairs of a group are compared; sooner where groups
#: hold no more than this many classes on average.
HUB_ROUNDS, FEW = 2, 8
#: Classes of a block of a group, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
_SEEDS = mix(np.arange(1, 2 * LONG_BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 55) - 1)


def band_rows(percent: int) -> int:
    """Coordinates of a band; 0: all sets share one band."""
    share = min(1.0, max(0.0, percent / 100))
    return next((rows for rows in range(BINS, 0, -1) if (1 - share**rows) ** (BINS // rows) <= BAND_MISS), 0)


def band_count(percent: int) -> int:
    rows = band_rows(percent)
    return BINS // rows if rows else 1


def least_agreement(percent: int, size: int = BINS) -> int:
    """Coordinates in which sketches must agree for a full comparison."""
    share = min(1.0, max(0.0, percent / 100))
    missed = 0.0
    for agree in range(size):
        missed += math.comb(size, agree) * share**agree * (1 - share) ** (size - agree)
        if missed > AGREE_MISS:
            return agree
    return size


def sketch(shingles: np.ndarray, size: int = BINS) -> np.ndarray:
    """The ``size`` (a power of two up to 512) coordinates of a non-empty set."""
    bins = np.full(size, _FULL)
    done, n = 0, len(shingles)
    top = np.uint64(65 - size.bit_length())
    while done < 2 * size and (bins == _FULL).any():
        rounds = np.arange(done, min(2 * size, done + max(1, 5 * size // n)), dtype=np.uint64)
        hashed = mix(shingles[None, :] ^ _SEEDS[rounds][:, None])
        place = (hashed >> top).astype(np.int64)
        fixed = rounds >= size
        if fixed.any():
            place[fixed] = (rounds[fixed] - np.uint64(size)).astype(np.int64)[:, None]
        np.minimum.at(bins, place.ravel(), ((rounds[:, None] << np.uint64(55)) | (hashed & _LOW)).ravel())
        done += len(rounds)
    return bins


def coordinate_bytes(coordinates: np.ndarray) -> bytes:
    """One byte of each coordinate, enough to count how many agree."""
    return mix(coordinates).astype(np.uint8).tobytes()


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    count = BINS // rows if rows else 1
    out = np.arange(1, count + 1, dtype=np.uint64)
    for column in coordinates[: count * rows].reshape(count, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_key, bands, coords`` of every row; written once."""
    rows_of_band = band_rows(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in by_bytes(batches):
                sizes, keys, groups, coords = [], [], [], []
                for found in shingle_sets(batch.column("text").to_pylist(), k):
                    sizes.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    filled = sketch(found) if len(found) else None
                    groups.append([] if filled is None else bands(filled, rows_of_band))
                    coords.append(None if filled is None else coordinate_bytes(filled))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.list_(pa.int64())), pa.array(coords, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "coords"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return kept(rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, coords binary"), "signatures")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (``a, b``, written) that reach the similarity on their full sets; written once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(by_bytes(batches, "left"), "right"):
            lefts, rights = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good, last, set_a = [], None, None
            for left, b in zip(lefts, shingle_sets(rights, k), strict=True):
                if left != last:
                    last, set_a = left, next(shingle_sets([left], k))
                both = len(np.intersect1d(set_a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(set_a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("right"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return kept(rows.mapInArrow(compare, "a binary, b binary"), "links")


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _by_root(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    labelled = crowd.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    return labelled.withColumn("root", F.coalesce("root", "set_key"))


def _hub_pairs(crowd: DataFrame, sets: DataFrame, turn: int, percent: int, most: int) -> DataFrame:
    """Pairs of each group's hub of this turn with the members of other components that agree with it.

    A pair that several bands make is told once, and only then is sent the sketches of its two sets.
    """
    least = least_agreement(percent)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((one == other).sum(axis=1) >= least))

    order = F.xxhash64("set_key", F.lit(turn))
    hubs = crowd.groupBy("band").agg(F.min(F.struct(order.alias("order"), "set_key", "n", "root")).alias("hub"))
    met = crowd.join(kept(hubs, "hubs", most), "band").filter((F.col("root") != F.col("hub.root")) & _fits(F.col("n"), F.col("hub.n"), percent))
    pairs = met.select(F.greatest("hub.set_key", "set_key").alias("a"), F.least("hub.set_key", "set_key").alias("b")).distinct()
    left = sets.select(F.col("set_key").alias("a"), F.col("coords").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("coords").alias("y"))
    sketched = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return sketched.mapInArrow(agreeing, "a binary, b binary")


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """``set_key, shingles, fine``: full sets and long sketches of ``texts``; written once."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in by_bytes(batches):
                sets = list(shingle_sets(part.column("text").to_pylist(), k))
                fine = [coordinate_bytes(sketch(found, LONG_BINS)) for found in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_key"), pa.array([found.tobytes() for found in sets], pa.binary()), pa.array(fine, pa.binary())],
                    names=["set_key", "shingles", "fine"],
                )

    return kept(texts.mapInArrow(fill, "set_key binary, shingles binary, fine binary"), "full-sets")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of groups (``band``) copied to the pairs of blocks (``i, j``) of their group."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    blocks = kept(rows.groupBy("band").agg(size.cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _partners(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a block pair, each with the later places in other components that may be linked to it.

    Band values stand in the order of the bands, so the first band that two classes share is told by
    comparing what stands before this group's; the pair belongs to the group of that band.
    """
    roots = np.array(group.column("root").to_pylist(), object)
    sizes, own = group.column("n").to_numpy(), group.column("own").to_numpy()
    crossing = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    coords = _matrix(group.column("coords"), np.uint8, BINS)
    bands_of = np.array(group.column("bands").to_pylist(), np.int64)
    earlier = bands_of[:, : int(np.flatnonzero(bands_of[0] == group.column("band")[0].as_py())[0])]
    fine = _matrix(group.column("fine"), np.uint8, LONG_BINS) if "fine" in group.column_names else None
    least, least_fine = least_agreement(percent), least_agreement(percent, LONG_BINS)
    for at in range(len(roots) - 1):
        fits = 100 * np.minimum(sizes[at + 1 :], sizes[at]) >= percent * np.maximum(sizes[at + 1 :], sizes[at])
        fits &= roots[at + 1 :] != roots[at]
        if crossing:
            fits &= own[at + 1 :] != own[at]
        spots = at + 1 + np.flatnonzero(fits)
        spots = spots[(coords[spots] == coords[at]).sum(axis=1) >= least]
        spots = spots[~(earlier[spots] == earlier[at]).any(axis=1)]
        if fine is not None:
            spots = spots[(fine[spots] == fine[at]).sum(axis=1) >= least_fine]
        if len(spots):
            yield at, spots


def _forest(crowd: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join whatever is linked in a group but in different components yet; written once.

    Groups are compared block by block inside the tasks; pairs at the similarity are passed over with a
    probability below twice ``AGREE_MISS``. First only sketches are sent; classes with a possible partner
    are sent again with their sets.
    """

    def partnered(group: pa.Table) -> pa.Table:
        found: set[int] = set()
        for at, spots in _partners(group, percent):
            found.add(at)
            found.update(spots.tolist())
        return group.select(["band", "set_key"]).take(pa.array(sorted(found), pa.int64()))

    def joined(group: pa.Table) -> pa.Table:
        keys, sets = group.column("set_key").to_pylist(), group.column("shingles")
        label = group.column("root").to_pylist()
        parent = {root: root for root in label}

        def root(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def full_set(at: int) -> np.ndarray:
            return np.frombuffer(sets[at].as_buffer(), np.uint64)

        out: list[tuple[bytes, bytes]] = []
        for at, spots in _partners(group, percent):
            mine = full_set(at)
            for spot in spots.tolist():
                if root(label[at]) == root(label[spot]):
                    continue
                other = full_set(spot)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    parent[root(label[at])] = root(label[spot])
                    out.append((max(keys[at], keys[spot]), min(keys[at], keys[spot])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    crowd = crowd.join(sets.select("set_key", "bands", "coords"), "set_key")
    some = _dealt(crowd).groupBy("band", "i", "j").applyInArrow(partnered, "band long, set_key binary")
    some = kept(some.distinct(), "partnered")
    full = _full_sets(texts.join(some.select("set_key").distinct(), "set_key", "left_semi"), k)
    again = crowd.join(some, ["band", "set_key"], "left_semi").join(full, "set_key")
    return kept(_dealt(again).groupBy("band", "i", "j").applyInArrow(joined, "a binary, b binary"), "forest")


def _open_groups(crowd: DataFrame, most: int) -> DataFrame:
    """Members of the groups in which more than one component is left; written once."""
    open_bands = crowd.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return kept(crowd.join(kept(open_bands.select("band"), "open-bands", most), "band"), "open-groups", most)


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The signatures, and ``set_key, component_id, row`` of every non-empty set; both written. ``row`` names
    the component's row that stays by ``doc_id, text_hash``."""
    signed = signatures(docs, k, percent)
    sets = kept(
        signed.filter("n_shingles > 0").groupBy("set_key").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"), F.min("doc_id").alias("low_id"),
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("coords").alias("coords"),
        ),
        "sets",
    )
    # A row for each band of a set: the sketches stay in ``sets``.
    members = sets.select(F.explode("bands").alias("band"), "set_key", "n")
    most = band_count(percent) * sets.count()
    crowded = kept(members.groupBy("band").count().filter("count > 1").select("band"), "crowded", most)
    crowd = kept(members.join(crowded, "band"), "crowd", most).withColumn("root", F.col("set_key"))
    most = crowd.count()
    wanted = sets.join(crowd.select("set_key").distinct(), "set_key", "left_semi").select(F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"), "set_key")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("hash"))
    texts = docs.select("doc_id", "text").join(wanted, same).select("set_key", "text")
    repeated = signed.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    texts = kept(texts.dropDuplicates(["set_key"]) if repeated else texts, "texts")

    met = kept(_hub_pairs(crowd, sets, 0, percent, most), "pairs", most)
    links = confirmed(met, texts, k, percent)
    roots = components(links)
    for turn in range(1, HUB_ROUNDS + 2):
        crowd = _open_groups(_by_root(crowd.drop("root"), roots), most)
        size = crowd.groupBy("band").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("squares")).first()
        if not size.rows:
            break
        if turn > HUB_ROUNDS or size.squares <= FEW * size.rows:
            found = _forest(crowd, sets, texts, k, percent)
            if not found.isEmpty():
                roots = components(links.unionByName(found))
            break
        pairs = kept(_hub_pairs(crowd, sets, turn, percent, most).join(met, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            found = confirmed(pairs, texts, k, percent)
            met = met.unionByName(pairs)
            if not found.isEmpty():
                links = links.unionByName(found)
                roots = components(links)
    count = sets.count()
    rooted = kept(_by_root(sets.select("set_key", "low_id", "row"), roots), "rooted", count)
    lowest = kept(rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.min("row").alias("row")), "lowest", count)
    found = rooted.select("set_key", "root").join(lowest, "root")
    return signed, kept(found.select("set_key", "component_id", "row"), "near-components", count)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    signed, found = linked(docs, k, percent)
    rows = kept(signed.groupBy("doc_id", "n_shingles", "set_key").count(), "near-rows", signed.count())
    joined = rows.join(found, "set_key", "left").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    stays = F.col("doc_id").eqNullSafe(component) & (F.col("turn") == 1)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), stays.alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each component, and those without a word."""
    signed, found = linked(docs, k, percent)
    named = found.select("row.doc_id", "row.text_hash").distinct()
    wordless = signed.filter("n_shingles = 0").select("doc_id", "text_hash").distinct()
    stay = kept(named.unionByName(wordless).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "near-kept", signed.count())
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__hash"))
    out = docs.join(stay, same, "left_semi")
    repeated = signed.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
