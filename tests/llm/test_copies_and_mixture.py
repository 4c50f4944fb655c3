"""Copies, repeats, mixture, packing and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortgate.llm import components, digests, minhash, mixing, packing, parsing, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, digest string, kept string, offset int, set_key string, low int"


def frame(spark, rows, parts=3):
    full = [(i, t, "en", s, 0, 1, "d", "k", 2, "s", 3) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(parts)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- exact copies ------------------------------------------------------------------------------


def test_exact_copies(spark):
    rows = [(i, ["Abc", "aBC", "É", "é", "", None, "x" * 100_000, "İ"][i % 8], None) for i in range(40)]
    rows += [(100, "once", "s"), (39, rows[39][1], None), (39, rows[39][1], None)]
    docs = frame(spark, rows)
    got = digests.deduplicated(docs).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lowered(t)].append(i)
    expected = Counter()
    for key, ids in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        for at, i in enumerate(sorted(ids, reverse=True)):
            expected[(i, max(ids), len(ids), at == 0, digest)] += 1
    assert Counter(map(tuple, got)) == expected
    stay = digests.survivors(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(max(ids) for ids in groups.values())
    assert digests.deduplicated(docs.limit(0)).count() == 0 and digests.survivors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_survivors_with_null_ids_and_shared_ids(spark, repeated):
    rows = [(None, f"without id {i}", None) for i in range(20)] + [(None, "Shared", None), (3, "shared", None)]
    rows += [(7, "one text", None), (7, "another text", None), (8, None, None), (8, "x", None)]
    rows += [(9, "again", None), (9, "AGAIN", None), (None, "Without ID 4", None)] if repeated else [(9, "again", None)]
    got = Counter((r.doc_id, lowered(r.text)) for r in digests.survivors(frame(spark, rows)).collect())
    largest = {}
    for i, t, _ in rows:
        largest[lowered(t)] = max(largest.get(lowered(t), -1), -1 if i is None else i)
    assert got == Counter((None if i < 0 else i, t) for t, i in largest.items())


def test_index_persists(spark, tmp_path):
    first = digests.DigestIndex(spark, str(tmp_path / "index"), 4)
    first.absorb(spark.createDataFrame([(b"a", 1), (b"a", 5), (b"b", 2)], "digest binary, doc_id long"))
    again = digests.DigestIndex(spark, str(tmp_path / "index"), 4)
    again.absorb(spark.createDataFrame([(b"a", 9), (b"c", 3)], "digest binary, doc_id long"))
    assert {(bytes(r.digest), r.doc_id) for r in again.rows().collect()} == {(b"a", 5), (b"b", 2), (b"c", 3)}


@pytest.mark.parametrize("reopened", [None, 8])
def test_index_is_reopened_with_its_own_buckets(spark, tmp_path, reopened):
    path = str(tmp_path / "index")
    arrival = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"))
    digests.DigestIndex(spark, path, 8).absorb(arrival)
    with pytest.raises(ValueError, match="8 buckets, not 4"):
        digests.DigestIndex(spark, path, 4)
    again = digests.DigestIndex(spark, path, reopened)
    again.absorb(arrival)
    assert again.buckets == 8 and again.rows().count() == 100


# --- near copies -------------------------------------------------------------------------------


def plain_set(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain_components(rows, k):
    sets = [(i, plain_set(t, k)) for i, t, _ in rows]
    low = {i: i for i, _ in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                low[q] = p
    return {i: (len(x), root(i)) for i, x in sets}


@pytest.mark.parametrize(("k", "few"), [(2, 8), (5, 0)])
def test_near_copies(spark, monkeypatch, k, few):
    monkeypatch.setattr(minhash, "FEW", few)  # 0: further hubs before all pairs
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(80)]
        for copy in range(12):
            mine = list(words)
            for _ in range(rng.randrange(4 + base)):
                mine[rng.randrange(len(mine))] = rng.choice(vocabulary)
            rows.append((100 * base + copy, " ".join(mine), None))
    rows += [(1000 + i, t, None) for i, t in enumerate([None, "", " \t", "One", "one", "one two", "ONE  two", "one two three", "a b c d e", "A b\nc d e", "é É"])]
    rows += [(2000, " ".join(rng.choice(vocabulary) for _ in range(20_000)), None)]
    expected = plain_components(rows, k)
    docs = frame(spark, [*rows, rows[0], rows[-1]])
    got = minhash.near_duplicates(docs, k).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert sorted(r.doc_id for r in got if r.kept) == sorted(i for i, (_, c) in expected.items() if i == c)
    stay = minhash.survivors(docs, k)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def linked_sets(rows, k, percent):
    """Smallest id of each component at this similarity."""
    sets = {i: plain_set(t, k) for i, t, _ in rows}
    low = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        before = dict(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low
    return low


@pytest.mark.parametrize(("percent", "both", "alone", "common"), [(60, 12, 14, 30), (50, 30, 15, 0), (30, 18, 21, 0), (5, 3, 28, 0)])
def test_near_copies_at_other_similarities(spark, percent, both, alone, common):
    rows = []
    for pair in range(30):  # a pair just reaches the similarity; what all share lies below it
        shared = [f"all{i}" for i in range(common)] + [f"p{pair}s{i}" for i in range(both)]
        rows += [(2 * pair + side, " ".join([*shared, *(f"p{pair}x{side}n{i}" for i in range(alone))]), None) for side in range(2)]
    expected = linked_sets(rows, 1, percent)
    assert expected == {i: i - i % 2 for i in range(60)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 1, percent).collect()}
    assert got == expected


def test_bands_and_agreement_follow_the_similarity():
    assert (minhash.band_rows(80), minhash.band_count(80), minhash.least_agreement(80)) == (4, 32, 75)
    for percent in range(1, 101):
        rows, least = minhash.band_rows(percent), minhash.least_agreement(percent)
        share = percent / 100
        assert rows == 0 or (1 - share**rows) ** minhash.band_count(percent) <= 1e-7
        assert sum(math.comb(128, n) * share**n * (1 - share) ** (128 - n) for n in range(least)) <= 1e-8


@pytest.mark.parametrize("block", [4, 1024])
def test_many_documents_around_a_passage_are_linked_by_a_forest(spark, monkeypatch, block):
    """Most share a passage below the similarity; some chains of them reach it."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    rng = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"{passage} {' '.join(f'own{i}x{j}' for j in range(rng.randrange(20, 60)))}", None) for i in range(60)]
    for i in range(0, 30, 3):
        words = rows[i][1].split()
        for step in (1, 2):
            words = words[:-3] + [f"new{i}y{step}z{j}" for j in range(3)]
            rows.append((100 * step + i, " ".join(words), None))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 2).items()}
    assert len(set(got.values())) == 60


def test_rows_of_bands_carry_no_sketch(spark, monkeypatch):
    """A set has 32 rows of bands, so what they carry is written and shuffled 32 times."""
    written = {}

    def recorded(df, name, rows=None):
        written.setdefault(name, set(df.columns))
        return plain(df, name, rows)

    plain = minhash.kept
    monkeypatch.setattr(minhash, "kept", recorded)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"]), None) for i in range(30)]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()} == {0}
    assert "coords" in written["sets"]
    assert written["crowd"] == {"band", "set_key", "n"} and written["hubs"] == {"band", "hub"}


def test_one_row_of_a_component_stays_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = [(None, f"{text} {x}", None) for x in ("a", "b", "c")]
    shared = [(7, f"other {text[::-1]} {x}", None) for x in ("a", "b")]
    mixed = [(i, f"mixed {text.replace('w', 'm')} {x}", None) for i, x in ((None, "q"), (None, "r"), (9, "s"))]
    blank = [(None, None, None), (None, "", None), (3, " ", None)]
    stay = Counter((r.doc_id, r.text) for r in minhash.survivors(frame(spark, near + shared + mixed + blank), k=5).collect())
    parts = [{(i, t) for i, t, _ in group} for group in (near, shared, mixed)]
    assert sum(stay.values()) == len(stay) == 3 + 3
    assert all(sum(row in part for row in stay) == 1 for part in parts)
    assert any(i == 9 for i, _ in stay) and all((i, t) in stay for i, t, _ in blank)


def test_near_copies_of_nothing(spark):
    empty = frame(spark, []).limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.survivors(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for n in (1, 3, 20, 400, 5000):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            one, two = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 4, dtype=np.uint64)])) for _ in range(2))
            a, b = minhash.sketch(one), minhash.sketch(two)
            assert not (a == np.uint64(2**64 - 1)).any()
            true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
            assert abs((a == b).mean() - true) < 0.2


def test_long_text_shingles():
    text = "alpha beta gamma " * 400_000
    assert [len(s) for s in shingles.shingle_sets([text, "x", None, "alpha beta"], 2)] == [3, 1, 0, 1]


def test_components(spark):
    links = [(f"{a:03}", f"{a + 1:03}") for a in range(40)] + [("900", "901"), ("901", "900"), ("950", "950")]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a string, b string")).collect()))
    assert got == {**{f"{a:03}": "000" for a in range(1, 41)}, "901": "900"}


# --- repeats -----------------------------------------------------------------------------------


def plain_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(d)) if gone[p] and not (p and gone[p - 1]))
        out[(i, len(d), sum(gone), runs, bytes(x for x, g in zip(d, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize(("hot", "piece"), [(4096, 4_000_000), (1, 64)])
def test_repeated_strings(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(parsing, "PIECE", piece)
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passages = [noise(n) for n in (39, 40, 41, 60, 200)]
    rows = [(i, noise(rng.randrange(120)) + rng.choice(passages) + noise(rng.randrange(90)) + rng.choice(passages), None) for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "a" * 500, None), (103, "ab" * 100, None), (104, noise(3000), None), (105, passages[4][50:], None), (0, rows[0][1], None)]
    left = parsing.without_repeats(frame(spark, rows), length=40, span=16, hot=hot).collect()
    got = Counter((r.doc_id, r.n_bytes, sum(x.stop - x.begin for x in r.removed), len(r.removed), bytes(r.kept_text)) for r in left)
    assert got == plain_repeats(rows, 40)
    assert parsing.without_repeats(frame(spark, []).limit(0)).count() == 0


# --- mixture -----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, capped = dict.fromkeys(order, 0.0), set()
    total = sum(sizes.values())
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        live = [s for s in order if s not in capped]
        for s in live:
            target[s] = left * weight[s] / sum(weight[x] for x in live)
        over = {s for s in live if target[s] > limit * sizes[s]}
        if not over:
            return {s: float(limit * sizes[s]) if s in capped else target[s] for s in order}
        capped |= over


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", "c", "", None, "Z"] + ["hot"] * 6)) for i in range(1500)]
    rows += [(2000, None, "nil"), (2001, "", "nil"), (2002, "x y", "tiny"), (2002, "x y", "tiny"), (None, "q", "a"), (2003, "w " * 50_000, "hot")]
    docs = frame(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = plain_targets(sizes)
    got = mixing.copies(docs).select("doc_id", "source", "__mix.*").collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - targets[r.source]) <= 1e-6 * max(1, targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - targets[s]) < 0.15 * targets[s] for s in ("a", "b", "c", "", None, "Z"))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    again = {(r.doc_id, r["__mix"].copies) for r in mixing.copies(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_one_id_are_drawn_apart(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 else 5, f"text {i} " * rng.randrange(1, 9), "a") for i in range(1200)] + [(i, "w " * 8, "b") for i in range(2000)]
    rows += [(None, "same " * 6, "a")] * 301 + [(8, "same again", "b")] * 40
    docs = frame(spark, rows)
    got = mixing.copies(docs).select("source", "__mix.*").collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.06 * own[0].target
    out = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    assert sum(out.values()) == sum(r.copies for r in got)
    again = Counter((r.doc_id, r.text) for r in mixing.mixed(docs.repartition(7)).collect())
    assert out == again


def test_targets_with_many_caps():
    assert plain_targets({"a": 1, "b": 1, "c": 100}) == {"a": 3.0, "b": 3.0, "c": 96.0}


# --- packing -----------------------------------------------------------------------------------


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rng = random.Random(7)
    texts = ["word " * rng.randrange(30) + rng.choice(["a  b", "x\ny z", "é ß", "<|endoftext|> q", " lead", "tail ", "\tt"]) for _ in range(200)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(500, None, None), (501, "", None), (502, "long " * 9000, None), (0, texts[0], None)]
    docs = frame(spark, rows)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=64)
    placed = packing.packed(cut, capacity=64).withColumn("crc", F.crc32("ids")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at, piece, size = 0, 0, len(ids) % 64 or 64
        while at < len(ids):
            expected[(i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()))] += 1
            at, piece, size = at + size, piece + 1, 64
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in placed) == expected
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= 1.06 * sum(r.length for r in placed) / 64 + 1
    whole = packing.sequences(packing.packed(cut, capacity=64)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole) and len(whole) == len(sequences)
    assert packing.packed(cut.limit(0)).count() == 0


def test_records_are_broadcast_up_to_a_bound(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id as doc_id", "1 + id % 40 as length")
    few = packing.packed(rows, capacity=64)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    many = packing.packed(rows, capacity=64)
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    spots = [sorted((r.length, r.sequence_id, r.offset) for r in d.collect()) for d in (few, many)]
    assert spots[0] == spots[1] and len(spots[0]) == 300


def test_placements_are_best_fit():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 101) for _ in range(5000))
    gaps = []
    for length in sorted(counts.elements(), reverse=True):  # best fit decreasing, one by one
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(100 - length)
        else:
            gaps.remove(fit)
            gaps.append(fit - length)
    records = packing.placements(counts, 100)
    assert sum(r[2] for r in records) == 5000
    assert max(r[3] + r[2] for r in records) <= 1.01 * len(gaps)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "12345 !!", "en", "s", 8)], source.schema)
    docs = source.unionByName(odd)
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], sf_dir).persist())
    named, exact, near, mix, packed = states[1:]
    assert all(s.columns == source.columns for s in states[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in named.collect()}
    assert kept == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    largest = {}
    for i in sorted(kept):
        largest[lowered(texts[i])] = i
    assert sorted(r.doc_id for r in exact.collect()) == sorted(largest.values())
    expected = plain_components([(i, texts[i], None) for i in largest.values()], 5)
    stay = {i for i, (_, c) in expected.items() if i == c}
    assert sorted(r.doc_id for r in near.collect()) == sorted(stay)
    times = {r.doc_id: r["__mix"].copies for r in mixing.copies(near).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in times.items() if n})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in times}
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(n * tokens[i] for i, n in times.items())
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
