"""Top-k search, language, toxicity, URL rules and secret scans against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgate.llm import bitslice, language, secrets, toxicity, urlrules

# --- top-k -------------------------------------------------------------------------------------


def plain_top(rows, k):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_top_k(spark, block_rows):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x", 1) for i in range(120)]
    rows += [(200 + i, rows[3][1], "tie", 2) for i in range(9)]  # ties at the boundary
    rows += [(300, None, "", 0), (301, [], "", 0), (302, [1.0, None] + [0.0] * 4, "", 0), (350, [float("nan")] * 6, "", 0)]
    rows += [(303, [float("inf")] * 6, "", 0), (304, [0.5, 0.25], "", 0), (400, [0.1, -0.2], "", 0), (None, [0.0] * 6, "", 0)]
    rows += [(450, [0.0] * 6, "", 0), (500, [1e6] + [-3.0] * 5, "", 0), (501, [2e6] * 6, "", 0), (550, [-3e5, 7e5] + [1e6] * 4, "", 0), (50, rows[50][1], "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, block int").repartition(3)
    got = bitslice.top_k(frame, F.col("vec_id") % 50 == 0, 5, 256, block_rows).collect()
    unique = {r[0]: r for r in rows if r[0] is not None}
    expected = plain_top([r for r in rows if r[0] != 50] + [unique[50]], 5)
    seen = {tuple(r) for r in got}
    assert {r for r in seen if r[0] != 50} >= {r for r in expected if r[2] != 50 and r[0] != 50 and all(x[2] != 50 for x in expected if x[0] == r[0])}
    assert len(got) == len(seen)
    plain = [r for r in rows if r[0] != 50]
    clean = bitslice.top_k(frame.filter("vec_id <> 50 or vec_id is null"), F.col("vec_id") % 50 == 0, 5, 256, block_rows)
    assert {tuple(r) for r in clean.collect()} == plain_top(plain, 5)


def test_wide_components():
    """Scores near the ends of a long, and spans beyond it, are exact."""
    rng = random.Random(8)
    values = np.array([[rng.randrange(-(2**63), 2**63), rng.randrange(-(2**20), 2**20)] for _ in range(100)], np.int64)
    made = bitslice.SlicedBlock.of(np.arange(100), values)
    for query in (np.array([1, 0]), np.array([-1, 3]), np.array([0, -(2**40)]), np.array([2**62, -5])):
        scores = sorted((-sum(map(int.__mul__, v, query.tolist())), i) for i, v in enumerate(values.tolist()) if i != 7)
        assert made.top(7, query, 9) == [(i, -s) for s, i in scores[:9]]


@pytest.mark.parametrize("value", [1e30, 1e9])
def test_no_right_long_stops(spark, value):
    frame = spark.createDataFrame([(i, [value, value]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        bitslice.top_k(frame, F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitslice.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0


# --- language ----------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred string"


def test_cross_parsing(spark):
    rng = random.Random(1)
    words = {"aa": ["kolo", "mira", "tano", "sedu"], "bb": ["xyß", "quä", "wöx", "zzyx"]}
    rows = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, None, "s", "p"))
    rows += [(100, None, None, None, None, None), (101, "", None, None, None, None), (102, "12 34 !!", None, None, None, None)]
    rows += [(103, ("KOLO MIRA " * 20_000), None, None, None, None), (104, "中文", None, None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    samples = language.learned_samples(docs, F.col("doc_id") % 5 != 0)
    assert set(samples) == {"aa", "bb"}
    got = language.predicted(docs, samples).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(80))
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert by_id[104].lang_pred in ("aa", "bb") and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.predicted(docs, {}).collect()} == {"und"}
    assert language.predicted(docs.limit(0), samples).count() == 0


def plain_phrases(sample, text, block):
    """Longest matches told by substring search, with a cut every ``block`` letters."""
    count = 0
    for low in range(0, len(text), block):
        count, phrase = count + 1, ""
        for c in text[low : low + block]:
            if phrase + c in sample:
                phrase += c
            else:
                count, phrase = count + 1, c if c in sample else ""
    return count


@pytest.mark.parametrize("cells", [48_000_000, 900, 0])
def test_phrases_equal_plain_longest_matches(monkeypatch, cells):
    monkeypatch.setattr(language, "DENSE_CELLS", cells)
    monkeypatch.setattr(language, "BLOCK", 40)
    rng = random.Random(2)
    samples = {lang: "".join(rng.choice(letters) for _ in range(120)) for lang, letters in (("xx", "abc "), ("yy", "cde "), ("aa", "日月火 "))}
    parser = language.CrossParser(samples)
    texts = ["".join(rng.choice("abcde日月水 ") for _ in range(rng.randrange(1, 130))) for _ in range(60)]
    texts = [" ".join(t.split()) for t in texts]
    parsed = [parser.symbols(t)[0] for t in texts]
    got = parser.bits(parsed) / parser.costs * np.maximum([len(t) for t in parsed], 1)[:, None]
    for text, row, cut in zip(texts, got, parsed, strict=True):
        for lang, phrases in zip(parser.languages, row, strict=True):
            sample = "".join(c if c.isalpha() else " " for c in samples[lang])
            assert len(cut) == len(text) and round(phrases) == plain_phrases(re.sub(" +", " ", sample).lstrip(), text, 40)
    assert (len(parser.roots) < 3) == (cells < 1000) and len(parser.languages) == 3


def test_thousands_of_letters():
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 5000)]
    samples = {f"l{k}": "".join(rng.choice(letters[1000 * k : 1000 * k + 1000]) for _ in range(20_000)) for k in range(5)}
    parser = language.CrossParser(samples)
    assert len(parser.table) <= language.DENSE_CELLS and parser.sparse
    texts = ["".join(rng.choice(letters[1000 * (i % 5) : 1000 * (i % 5) + 1000]) for _ in range(200)) for i in range(50)]
    assert parser.predict(texts)[0] == [f"l{i % 5}" for i in range(50)]


def test_samples_spread_over_texts_and_documents(spark):
    rng = random.Random(6)
    rows = [(i, "header " * 400 + f"body{'abcdefghij'[i % 10]} " * 4000, "aa", None, None, None) for i in range(40)]
    rows += [(100 + i, t, "bb", None, None, None) for i in range(300) for t in [["", "12 34", "copy of a text"][i % 3]]]
    rows += [(1000 + i, "".join(rng.choice("klmnop ") for _ in range(50)), "bb", None, None, None) for i in range(60)]
    samples = language.learned_samples(spark.createDataFrame(rows, DOCS), F.lit(True), sample_docs=61, excerpt=500, sample_chars=4_000)
    texts = samples["bb"].split("\n")
    assert len(texts) == 61 and samples["bb"].count("copy of a text") == 1
    assert len(samples["aa"]) <= 4_000 and len({c for line in samples["aa"].split("\n") for c in re.findall(r"body([a-j])", line)}) >= 8
    assert samples["aa"].count("header") < samples["aa"].count("body")
    assert language.even_parts(["abc", "defghijk", "lm"], 9) == ["ab", "def", "lm"]
    assert sum(map(len, language.even_parts(["a" * 50] * 7, 100))) + 6 <= 100


def test_phrases_are_longest_matches():
    parser = language.CrossParser({"aa": "abracadabra", "bb": "zzz"})
    symbols, _ = parser.symbols("abrabracadz")
    phrases = parser.bits([symbols]) * len(symbols) / parser.costs
    # aa: abra | bracad | z; bb: ten single letters that it lacks each end a phrase
    assert phrases[0, 0] == 3


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["this", "that", "word", "table", "river", "house"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(plain) for _ in range(25)]
        if i % 4 == 0:
            text[rng.randrange(25)] = rng.choice(["grobian", "lump"])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, None, None), (1001, "", None, None), rows[0]]
    labels += [(0, None, 0), (None, 1, 1), (5, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, score string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.ToxicityModel(docs, marked, F.col("doc_id") % 5 != 0, rounds=4)
    got = model.scored(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 400 and r.doc_id % 5 == 0]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert right / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.ToxicityModel(docs, none, F.lit(True)).scored(docs).collect()] == [0.0, 0.0]


# --- URL rules ---------------------------------------------------------------------------------


def test_wildcards():
    rng = random.Random(9)
    globs = ["*", "a*b", "?b*", "*ab*c?", "", "abc", "*" * 3 + "c", "a" * 70 + "*", "*^.[x]"]
    texts = ["".join(rng.choice("abc^") for _ in range(rng.randrange(8))) for _ in range(300)] + ["a" * 75, "", "q^.[x]"]
    got = urlrules.ShiftAnd(globs).matches(texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
            assert got[i, j] == bool(re.fullmatch(pattern, text, re.S)), (glob, text)


def test_url_rules(spark):
    rules = [urlrules.UrlRule("allow", "org", "/"), urlrules.UrlRule("block", "example.org", "/es/"), urlrules.UrlRule("block", "com", "/x"), urlrules.UrlRule("allow", "a.com", "/x?y")]
    urls = [
        "http://example.org/es/1", "http://EXAMPLE.org/es", "https://www.example.org/es/?q", "http://notexample.org/es/", "ftp://org/", "http://org",
        "http://b.com/x.org/", "http://b.com/y", None, "", "nohost", "http://", "http://a.com/xzy", "http://É.com/x", "x" * 5000 + "://a.org/" + "p" * 9000, "http://b.com/x\n#f", "a://b.org?://c.com/x",
    ]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlrules.judged(frame, rules).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and re.match(re.escape(r.path).replace(r"\?", "."), path, re.S)]
        best = max(fits, key=lambda r: (len(r.name), r.verdict == "block"), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best.name, best.verdict) if best else (None, "allow")), url
    assert urlrules.judged(frame.limit(0), rules).count() == 0
    assert {r.verdict for r in urlrules.judged(frame, [], "block").collect()} == {"block"}


# --- secrets -----------------------------------------------------------------------------------

KINDS = [
    ("assign", re.compile(secrets.ASSIGN, re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
]


def plain_spans(text):
    found = [(m.start(), place, m.end(), kind) for place, (kind, rule, good) in enumerate(KINDS) for m in rule.finditer(text or "") if good(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_secret_spans_and_ledger(spark):
    rng = random.Random(2)
    parts = [
        "password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "abc", "AKIA", "ABCD1234ABCD1234", "0123456789abcdef", "\n", "é", "\U0001f600", "a1b2c3d4",
        "-----BEGIN RSA PRIVATE KEY-----", "ſecret", "\u212a",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(250)]
    texts += [None, "", "secret=token = abcdefgh", "password=token=abcdefgh", "AKIAAKIA" + "A" * 16, "f" * 24, "f" * 23, "x" * 50_000 + " token: zzzzzz", "secret=token = abcdefgh"]
    frame = spark.createDataFrame([(i, t, "b", "s") for i, t in enumerate(texts)] + [(0, texts[0], "", "")], "doc_id long, text string, blob string, spans string")
    ledger = secrets.BlobLedger(spark)
    got = secrets.findings_of_paths(frame, ledger=ledger).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert [(s.kind, s.start, s.end) for s in row.spans] == plain_spans(texts[row.doc_id]), texts[row.doc_id]
    blobs = {hashlib.sha256((t or "").encode()).digest() for t in texts}
    assert ledger.scanned().count() == len(blobs)
    more = frame.limit(20).unionByName(spark.createDataFrame([(900, "token=newvalue", "", "")], frame.schema))
    again = secrets.findings_of_paths(more, ledger=ledger).collect()
    assert ledger.scanned().count() == len(blobs) + 1 and len(again) == 21
    assert secrets.findings_of_paths(frame.limit(0)).count() == 0


def test_joined_spans(spark):
    frame = secrets.scan(spark.createDataFrame([("token=abcdef " + "0" * 24,)], "text string"))
    assert frame.select(secrets.joined_spans(F.col("spans"))).first()[0] == "assign:0:12,hex:13:37"


def test_sketch_of_automaton_is_small():
    table = language.suffix_automaton(np.array([3, 3, 4, 3, 4]), 5)
    assert len(table) <= 2 * 5
