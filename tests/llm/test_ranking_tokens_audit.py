"""Ranked search, byte-level BPE and the filter audit against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortgate.llm import audit, prefixes, queries, ranking

COLUMNS = "doc_id long, text string, source string, n long, terms string, query string, score long, ids string, word string, part string, bits int"


def frame(spark, rows, parts=3):
    full = [(i, t, s, 1, "x", "q", 2, "i", "w", "p", 3) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(parts)


# --- ranked search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_ranking(docs, items, k):
    """Every document scored for every item."""
    counted = [(i, Counter(TERM.findall(lowered(t)))) for i, t, _ in docs]
    counted = [(i, c) for i, c in counted if c]
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    out = Counter()
    for key, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * len(counted)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall(lowered(text))) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, gone, i) in enumerate(sorted(scored)[:k], 1):
            out[(key, rank, None if gone else i, -score)] += 1
    return out


def got_ranking(spark, docs, items, k):
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    found = ranking.ranked(frame(spark, docs), asked, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, found.collect()))


def ranking_case(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "A1", "the", "THE"]
    weights = [1 / (1 + i) for i in range(len(words))]

    def text(n):
        return rnd.choice([" ", ", ", "\x00", "-"]).join(rnd.choices(words, weights, k=n))

    docs = [(i, text(rnd.randint(1, 60)), None) for i in range(150)]
    docs += [(200 + i, docs[3][1], None) for i in range(25)] + [docs[3], docs[3], (None, docs[3][1], None), (None, docs[3][1], "s")]
    docs += [(300, None, None), (301, "", None), (302, "... !?", None), (303, text(40_000), None), (304, "w1", None)]
    items = [(i, text(rnd.randint(1, 30))) for i in range(8)] + [(8, None), (9, ""), (10, "nowhere"), (11, docs[3][1]), (11, docs[3][1]), (None, "w1 w1 W1")]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_ranking_equals_scoring_all(spark, monkeypatch, seed):
    docs, items = ranking_case(seed)
    monkeypatch.setattr(ranking, "FIRST_DEPTH", 2)
    monkeypatch.setattr(ranking, "BLOCK_POSTINGS", 300)
    assert got_ranking(spark, docs, items, 10) == plain_ranking(docs, items, 10)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 200)
    assert got_ranking(spark, docs, items, 3) == plain_ranking(docs, items, 3)


def test_ranking_of_nothing(spark):
    assert got_ranking(spark, [], [(1, "a")], 10) == Counter()
    assert got_ranking(spark, [(1, "a", None), (2, None, None)], [], 10) == Counter()
    assert got_ranking(spark, [(1, None, None)], [(1, None)], 10) == Counter()
    assert got_ranking(spark, [(4, "a", None), (3, "a", None)], [(1, "a")], 1) == plain_ranking([(4, "a", None), (3, "a", None)], [(1, "a")], 1)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_sorted_reads_resolve_the_best(seed, k):
    rnd = np.random.default_rng(seed)
    size = int(rnd.integers(1, 400))
    lists, exact = [], np.zeros(size, np.int64)
    for _ in range(int(rnd.integers(1, 6))):
        docs = rnd.permutation(size)[: int(rnd.integers(1, size + 1))]
        impact = -np.sort(-rnd.integers(1, int(rnd.integers(2, 40)), len(docs)))
        lists.append((docs, impact))
        exact[docs] += impact
    left, scores = ranking.resolved(lists, size, [], k)
    assert (exact[left] == scores).all()
    best = np.lexsort((np.arange(size), -exact))[:k]
    assert set(best[exact[best] > 0]) <= set(left)


class Front:
    """A list of which only the front may be read."""

    def __init__(self, values, most):
        self.values, self.most = values, most

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        assert (at.stop if isinstance(at, slice) else at) <= self.most
        return self.values[at]


def test_reading_stops_early():
    """A document far ahead is resolved from the fronts of long lists."""
    size = 1 << 16
    rest = np.arange(size - 1, 0, -1)
    lists = [(Front(np.arange(size), 64), Front(np.concatenate([[10**9], rest // d]), 64)) for d in (2, 3)]
    left, scores = ranking.resolved(lists, size, [], 1)
    assert left.tolist() == [0] and scores.tolist() == [2 * 10**9]


def test_impacts_beyond_64_bits():
    n = np.array([10**12, 5], np.int64)
    tf = np.array([3, 1], np.int64)
    got = ranking.impacts(tf, n, 10**9, 10**13)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * x * 10**9 // 10**13)) for t, x in zip([3, 1], [10**12, 5])]


# --- byte-level BPE ----------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return prefixes.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})


def library_ids(library, text):
    return np.asarray(library.encode_ordinary(text or ""), "<u4").tobytes()


PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "日", "本", "1", "22", "!", "?", "'s", "'", "the", "ing", "　", "\t", "🙂", "\r\n", "x" * 30, "<|endoftext|>", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.data())
def test_ids_and_edits_equal_the_library(coder, library, pieces, data):
    text = "".join(pieces)
    ids = coder.ids(text)
    assert ids == library_ids(library, text) and coder.text(ids) == text.encode()
    start = data.draw(st.integers(0, len(text)))
    stop = data.draw(st.integers(start, len(text)))
    new = "".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=3)))
    changed, after = coder.revised(text, ids, start, stop, new)
    assert changed == text[:start] + new + text[stop:] and after == library_ids(library, changed)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=10), st.data())
def test_prefix_tables(coder, data, new, draw):
    words = coder.vocabulary
    table = prefixes.PrefixTable(words, data)
    assert [words.tokens[i] for i in table.ids()] == words.merged(data)
    for end in range(len(data) + 1):  # the entry of a prefix is the last token of its own encoding
        whole = words.merged(data[:end])
        assert (table.last[end] == words.ranks[whole[-1]]) if whole else end == 0
    table.append(new)
    assert table.last == prefixes.PrefixTable(words, data + new).last
    start = draw.draw(st.integers(0, len(data)))
    stop = draw.draw(st.integers(start, len(data)))
    table = prefixes.PrefixTable(words, data)
    table.edit(start, stop, new)
    assert table.last == prefixes.PrefixTable(words, data[:start] + new + data[stop:]).last


def test_edit_near_the_front_of_a_long_match_stops_early(coder, monkeypatch):
    words = coder.vocabulary
    data = b"thequickbrown" * 4000
    table = prefixes.PrefixTable(words, data)
    asked = []
    fits = words.fits
    monkeypatch.setattr(words, "fits", lambda before, token: asked.append(token) or fits(before, token))
    table.edit(5, 6, b"zz")
    assert len(asked) < 2000
    monkeypatch.undo()
    assert table.last == prefixes.PrefixTable(words, data[:5] + b"zz" + data[6:]).last


def test_encoding_of_tables(spark, library, monkeypatch):
    rnd = random.Random(3)
    texts = [None, "", " ", "a" * 70_000, "é" * 5_000, " ".join(rnd.choices(["the", "cat", "naïve", "日本語", "12", "!"], k=30_000))]
    texts += ["".join(rnd.choices(PIECES, k=rnd.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", None), (7, texts[7], None), (7, texts[7], None)]
    monkeypatch.setattr(prefixes, "REMEMBERED", 50)
    docs = frame(spark, rows)
    got = prefixes.encoded(docs, PATH, public_tokenizers.PATTERN)
    want = Counter((i, library_ids(library, t), (t or "").encode()) for i, t, _ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    back = prefixes.decoded(got.withColumn("ids", F.when(F.length("ids") > 0, F.col("ids"))), PATH, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, _ in rows)
    assert prefixes.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_revised_tables(spark, library):
    cases = [(1, "a cat sat", 2, 5, "dog"), (2, None, 0, 0, "new"), (None, "x y", 1, 1, None), (4, "one two", 90, 99, " three"), (5, "ab", -3, 1, "")]
    rows = [(i, t, library_ids(library, t) if t else None, a, b, n) for i, t, a, b, n in cases]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids binary, start long, stop long, new string")
    got = {r.doc_id: (r.text, bytes(r.ids)) for r in prefixes.revised(table, PATH, public_tokenizers.PATTERN).collect()}
    texts = {1: "a dog sat", 2: "new", None: "x y", 4: "one two three", 5: "b"}
    assert got == {i: (t, library_ids(library, t)) for i, t in texts.items()}


def test_whole_table_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_prefix_bpe(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for row in docs:
        ids, mine = library_ids(library, row.text), got[row.doc_id]
        assert mine.n_tokens == len(ids) // 4 and mine.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


# --- filter audit ------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good, toxic, lowest = set(), set(), {}
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    judged = []
    for i, t, part in docs:
        text = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bad = set()
        bad |= {"A"} if len(words) < 50 else set()
        bad |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and i > lowest[text] else set()
        judged.append((part or "", bad, i in good, i in toxic))
    rows, total = [], defaultdict(int)
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            for at, letter in enumerate(order):
                own = [(bad, g, x) for p, bad, g, x in judged if p == part]
                gone = [bool(bad & set(order[:at])) for bad, _, _ in own]
                removed = [row for row, out in zip(own, gone) if not out and letter in row[0]]
                total[part, letter] += len(removed)
                rows.append((
                    part, "".join(order), at + 1, letter,
                    sum(not out and letter not in row[0] for row, out in zip(own, gone)), len(removed),
                    sum(out and letter in row[0] for row, out in zip(own, gone)), sum(row[0] == {letter} for row in own),
                    sum(g for _, g, _ in removed), sum(x for _, _, x in removed),
                ))
    return Counter((p, o, s, *rest, total[p, letter]) for p, o, s, letter, *rest in rows)


def audit_rows():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "é", "x|y", "#", "DELTA", "of", "the"]
    docs = [(i, rnd.choice([" ", "\t", "\n\x0b"]).join(rnd.choices(words, [5, 1, 5, 5, rnd.random(), 0.1, 0.3, 9, 9], k=rnd.choice([3, 49, 50, 90]))), rnd.choice(["s", "t", None])) for i in range(60)]
    docs += [(i, " ".join(f"word{j}" for j in range(60)), "s") for i in (70, 71, 72, 71)]
    docs += [(80, None, None), (81, "", "s"), (None, "", "s"), (None, docs[0][1], "t"), (82, docs[0][1], "only"), (82, docs[0][1], "only")]
    docs += [(90, "y " * 200_000, "t"), (91, " wide space " * 60, "t")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 95, 2)] + [(4, 0, 1), (4, None, None), (None, 1, 1), (70, 1, 1), (71, 1, 0)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def got_audit(spark, docs, labels):
    table = spark.createDataFrame([(*row, "b") for row in labels], "doc_id long, quality int, toxic int, bits string")
    found = audit.audited(frame(spark, docs), table)
    return Counter(map(tuple, found.collect()))


def test_audit(spark, monkeypatch):
    docs, labels = audit_rows()
    want = plain_audit(docs, labels)
    assert got_audit(spark, docs, labels) == want
    monkeypatch.setattr(audit, "SHARD_BYTES", 2_000)
    assert got_audit(spark, docs, labels) == want
    assert got_audit(spark, [], labels) == Counter()
    assert got_audit(spark, docs[:3], []) == plain_audit(docs[:3], [])


@pytest.mark.parametrize("bits", [64, 5])
def test_codes_are_one_to_one(spark, bits):
    """Also where most words share a hash."""
    docs = frame(spark, audit_rows()[0])
    words, other = audit.dictionary(docs, bits)
    coded = {bytes(r.word): r.code for r in words.collect()}
    assert set(coded) == {w for _, t, _ in audit_rows()[0] for w in (t or "").encode().split()}
    assert len(set(coded.values())) == len(coded) and bool(other) == (bits == 5)
    assert all(code == other.get(word, audit.word_code(word, bits)) for word, code in coded.items())
    rows = audit.rows_of(audit.shards(docs, other, bits)).collect()
    want = Counter((i, s or "", len((t or "").encode().split()), len(set((t or "").encode().split()))) for i, t, s in audit_rows()[0])
    assert Counter((r.doc_id, r.part, r.words, r["distinct"]) for r in rows) == want
    total = defaultdict(int)
    for r in audit.shards(docs, other, bits).collect():
        for column, count in zip(r["columns"], r["counts"]):
            total[r["codes"][column]] += count
    assert total == Counter(coded[w] for _, t, _ in audit_rows()[0] for w in (t or "").encode().split())


def test_word_code_is_the_built_in_hash(spark):
    words = ["", "a", "é", "日本語", "x" * 200]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64(F.col("w").cast("binary")).alias("h")).collect()
    assert [r.h & -2 for r in rows] == [audit.word_code(w.encode()) for w in words]
    assert xxhash.xxh64_intdigest(b"a", 42) >= 0
