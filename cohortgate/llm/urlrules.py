"""URL filters: all glob rules packed into multiword Shift-And masks and run at once.

A glob is a text in which ``*`` stands for any run of characters and ``?`` for any one. Each
character of a glob is one bit of a state; the bits of all globs lie one after another in words of
64 bits and a shift carries from word to word. A step over one character of every URL in a batch
is a few array operations: shift the states, let in the first positions at the start, keep the bits
whose mask holds the character, and keep starred positions as they are. Globs are anchored at both
ends. URLs are read by one narrow scan; nothing is shuffled.

The canonical form is ``.`` + host + ``#`` + path, so a rule on a host fits its subdomains and can
never meet text of the path.

Defined results: a null url or one without ``://`` has an empty host and path; rows without a
fitting rule get the filter's default; ties of the longest rule go to the blocking one. Other
columns are neither read nor changed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.tables import ascii_lower

#: URLs that are stepped together; bounds the state arrays of a task.
BLOCK = 4096


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for hosts that are or lie under ``host`` and paths that fit ``path``, where a
    literal path fits every path that starts with it."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


class ShiftAnd:
    """The automaton of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        literals: list[str | None] = []
        starred: list[int] = []  # positions that may repeat: a star after the character before
        first, last = [], []
        for glob in globs:
            begin = len(literals)
            literals.append(None)  # a virtual position that is on before the first character
            if glob.startswith("*"):
                starred.append(begin)
            for c in glob:
                if c == "*":
                    starred.append(len(literals) - 1)
                else:
                    literals.append(c)
            first.append(begin)
            last.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        self.last = last
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for c in literals if c not in (None, "?")}))}
        masks = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)
        for at, c in enumerate(literals):
            if c is None:
                continue
            bit = np.uint64(1 << (at % 64))
            if c == "?":
                masks[:, at // 64] |= bit
            else:
                masks[self.alphabet[c], at // 64] |= bit
        self.masks = masks
        self.start = self._bits(first)
        self.stars = self._bits(starred)

    def _bits(self, places: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for at in places:
            out[at // 64] |= np.uint64(1 << (at % 64))
        return out

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """texts × globs, true where the whole text fits."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in order]
        known = np.array([0, *map(ord, self.alphabet)], np.uint32)
        sorted_known = np.argsort(known, kind="stable")
        begins = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([*points, np.zeros(0, np.uint32)])
        spot = np.searchsorted(known[sorted_known], flat).clip(0, len(known) - 1)
        symbols = np.where(known[sorted_known][spot] == flat, sorted_known[spot], 0)
        one = np.uint64(1)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # texts longer than step
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.masks[symbols[begins[:live] + step]]) | (now & self.stars)
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, at in enumerate(self.last):
            out[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & one == one
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def judged(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """Other columns of ``pages`` that were selected, then host, path, rule and verdict."""
    rules = list(rules)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), rules[k].verdict != "block", rules[k].name))
    globs = [rules[k].glob for k in ranked]
    names = np.array([rules[k].name for k in ranked] + [None], object)
    verdicts = np.array([rules[k].verdict for k in ranked] + [default], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                hosts = part.column("host").to_pylist()
                paths = part.column("path").to_pylist()
                fits = automaton.matches([f".{h}#{p}" for h, p in zip(hosts, paths, strict=True)])
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if ranked else np.full(len(hosts), 0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                    names=[*part.schema.names, "rule", "verdict"],
                )

    rest = [c for c in pages.columns if c not in (url, "host", "path", "rule", "verdict")]
    known = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{url}`").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    known = known.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    return known.mapInArrow(judge, f"{fields}, rule string, verdict string")
