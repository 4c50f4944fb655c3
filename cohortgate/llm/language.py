"""Language identification by cross-parsing.

A suffix automaton per language holds a bounded sample of labelled text. A text is cut greedily
into the longest phrases that occur in a language's sample; the language in which the phrases
carry the fewest bits per character wins. A phrase costs the logarithm of the sample's length, so
samples of unequal length compare fairly.

Greedy parsing only walks forward, so each automaton becomes one table of transitions in which a
missing one counts a phrase and restarts at the root. While states times letters of all languages stay
within ``DENSE_CELLS`` the table is full; a language beyond it (many languages, or thousands of
letters) keeps its transitions sorted by state and letter, about two a state, and looks them up. Both
give the same phrases, and memory grows with the samples alone. Texts are stepped together, a column of
characters at a time, over all languages. A phrase also ends every ``BLOCK`` characters, which
costs all languages the same and lets very long texts be stepped in parallel.

The sample is bounded by parameters: per language the ``sample_docs`` distinct texts with letters
of least hash, of each an excerpt of ``excerpt`` characters from a place chosen by hash (what is no
letter counts as one space), and ``sample_chars`` characters in all, spread evenly. Whole texts are
judged in one scan without a shuffle.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text
if nothing could be learned; ties go to the smaller language name; the order of rows and repeated
rows do not matter; an empty table gives an empty result; other columns are neither read nor
changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.llm.tables import kept, small_enough

UNDETERMINED = "und"
SEED = 11
#: Characters after which a phrase ends in any case, and characters that are stepped together.
BLOCK, BATCH_CHARS = 1024, 16_000_000
#: Cells of four bytes that the full tables of all languages hold together.
DENSE_CELLS = 48_000_000
_SPACE = 1
LETTER, NO_LETTERS = r"\p{L}", r"[^\p{L}]+"


def learned_samples(
    docs: DataFrame, eligible: Column, sample_docs: int = 96, excerpt: int = 2_000, sample_chars: int = 60_000
) -> dict[str, str]:
    """Sample text by language, from rows where ``eligible`` holds and text and lang are given."""
    usable = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    usable = usable.select(F.col("doc_id").alias("id"), "lang", "text", F.xxhash64("text", F.lit(SEED)).alias("hash"))
    distinct = usable.groupBy("lang", "hash").agg(F.min("id").alias("id"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    chosen = kept(distinct.withColumn("rank", rank).filter(F.col("rank") <= sample_docs), "language-samples")
    if small_enough(chosen):  # then texts are not shuffled to find the few that are taken
        chosen = F.broadcast(chosen)
    key = [usable["id"].eqNullSafe(chosen["id"]), usable["lang"] == chosen["lang"], usable["hash"] == chosen["hash"]]
    dense = F.regexp_replace("text", NO_LETTERS, " ")
    rows = usable.join(chosen, key, "left_semi").select("lang", "hash", dense.alias("text"))
    spare = F.greatest(F.char_length("text") - excerpt, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("hash"), spare) + 1).cast("int")
    cut = F.substring(F.col("text"), begin, F.lit(excerpt)).alias("text")
    out: dict[str, list[str]] = {}
    for row in sorted(rows.select("lang", "hash", cut).distinct().collect()):
        out.setdefault(row.lang, []).append(row.text)
    return {lang: "\n".join(even_parts(texts, sample_chars)) for lang, texts in sorted(out.items())}


def even_parts(texts: list[str], most: int) -> list[str]:
    """Beginnings of ``texts`` that hold ``most`` characters with the ends of lines, as even as lengths allow."""
    left, part = most + 1, {}
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for done, i in enumerate(order):
        part[i] = texts[i][: max(0, left // (len(order) - done) - 1)]
        left -= len(part[i]) + 1
    return [part[i] for i in range(len(texts)) if part[i]]


def suffix_automaton(symbols: np.ndarray, size: int | None = None) -> list[dict[int, int]]:
    """Transitions of every state; the root is state 0. Where ``size`` is given, a symbol not below it is refused."""
    if size is not None and len(symbols) and symbols.max() >= size:
        raise ValueError(f"symbol {symbols.max()} in an alphabet of {size}")
    links, lengths, nexts = [-1], [0], [{}]
    last = 0
    for c in symbols.tolist():
        here = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at != -1 and c not in nexts[at]:
            nexts[at][c] = here
            at = links[at]
        if at != -1:
            to = nexts[at][c]
            if lengths[to] == lengths[at] + 1:
                links[here] = to
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[to]))
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                while at != -1 and nexts[at].get(c) == to:
                    nexts[at][c] = copy
                    at = links[at]
                links[to] = links[here] = copy
        last = here
    return nexts


class SparseMoves:
    """Transitions sorted by state and letter."""

    def __init__(self, nexts: list[dict[int, int]], size: int):
        self.size = size
        counts = np.array([len(moves) for moves in nexts])
        letters = np.fromiter((c for moves in nexts for c in sorted(moves)), np.int64, counts.sum())
        self.keys = np.repeat(np.arange(len(nexts), dtype=np.int64), counts) * size + letters
        self.targets = np.fromiter((moves[c] for moves in nexts for c in sorted(moves)), np.int64, counts.sum())
        self.restart = np.zeros(size, np.int64)
        self.restart[list(nexts[0])] = list(nexts[0].values())

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended."""
        if not len(self.keys):
            return np.zeros_like(state), np.ones(len(state), bool)
        wanted = state * self.size + letter
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        there = self.keys[place] == wanted
        return np.where(there, self.targets[place], self.restart[letter]), ~there


class CrossParser:
    """The automata of all languages in one table, and the alphabet they share."""

    def __init__(self, samples: dict[str, str]):
        learned = [lang for lang, text in samples.items() if any(map(str.isalpha, text))]
        lowered = {lang: samples[lang].lower() for lang in learned}
        letters = sorted({c for text in lowered.values() for c in text if c.isalpha()})
        #: 0 pads, 1 is anything between words, 2 a letter that no sample has.
        self.size = len(letters) + 3
        symbol = {c: k + 3 for k, c in enumerate(letters)}
        points = np.full(0x110000, _SPACE, np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                points[point] = symbol.get(low[0], 2)
        self.points = points
        tables, roots, base = [], [], 0
        full, sparse, costs = [], [], {}
        self.sparse: list[SparseMoves] = []
        for lang in learned:
            nexts = suffix_automaton(self.symbols(lowered[lang])[0], self.size)
            costs[lang] = np.log2(max(2, len(nexts)))
            if (base + len(nexts)) * self.size > DENSE_CELLS:
                sparse.append(lang)
                self.sparse.append(SparseMoves(nexts, self.size))
                continue
            moves = np.full((len(nexts), self.size), -1, np.int32)
            for state, row in enumerate(nexts):
                if row:
                    moves[state, list(row)] = list(row.values())
            restart = np.where(moves[0] >= 0, moves[0], 0)
            table = (np.where(moves >= 0, moves, restart[None, :]) + base) * self.size
            table = np.where(moves >= 0, table, ~table)  # a negative entry ends a phrase
            table[:, 0] = (np.arange(len(moves)) + base) * self.size  # padding stays
            full.append(lang)
            tables.append(table.ravel().astype(np.int32))
            roots.append(base * self.size)
            base += len(moves)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        #: In the order of the columns of ``bits``; ties are told by name.
        self.languages = [*full, *sparse]
        self.by_name = np.argsort(np.array(self.languages, object), kind="stable") if learned else np.zeros(0, np.int64)
        self.costs = np.array([costs[lang] for lang in self.languages])

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols with runs between words as one, and whether there is any letter."""
        flat = self.points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = flat == _SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        if len(flat):
            keep[0] = not space[0]
        return flat[keep], bool((~space).any())

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts × languages: bits per character."""
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(lengths) - lengths, blocks) + within * BLOCK
        sizes = np.minimum(BLOCK, lengths[owner] - within * BLOCK)
        order = np.argsort(-sizes, kind="stable")
        owner, starts, sizes = owner[order], starts[order], sizes[order]
        flat = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.int32)
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        ended = np.ones((len(self.languages), len(owner)), np.int32)
        dense = len(self.roots)
        looked = np.zeros((len(self.sparse), len(owner)), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            letter = flat[starts[:live] + step]
            if dense:
                moved = self.table[state[:, :live] + letter]
                sign = moved >> 31  # -1 where a phrase ended
                ended[:dense, :live] -= sign
                state[:, :live] = moved ^ sign
            for k, moves in enumerate(self.sparse):
                looked[k, :live], over = moves.step(looked[k, :live], letter)
                ended[dense + k, :live] += over
        phrases = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            phrases[:, k] = np.bincount(owner, weights=ended[k], minlength=len(texts))
        return phrases * self.costs / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows, parsed, held = [], [], 0
        for at in range(len(texts) + 1):
            if at == len(texts) or held > BATCH_CHARS:
                if rows and self.languages:
                    bits = self.bits(parsed)
                    best = self.by_name[bits[:, self.by_name].argmin(axis=1)]
                    for row, lang, rest in zip(rows, best, bits, strict=True):
                        others = np.delete(rest, lang)
                        names[row] = self.languages[lang]
                        scores[row] = 1 - rest[lang] / others.min() if len(others) else 1.0
                rows, parsed, held = [], [], 0
            if at < len(texts) and texts[at]:
                symbols, letters = self.symbols(texts[at])
                if letters:
                    rows.append(at)
                    parsed.append(symbols)
                    held += len(symbols)
        return names, scores


_parsers: dict[int, CrossParser] = {}


def parser_of(samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, built once in each Python worker."""
    key = hash(tuple(samples.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def predicted(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from its column ``text``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = parser_of(samples).predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    rest = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(predict, f"{fields}, lang_pred string, score double")
