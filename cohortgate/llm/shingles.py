"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer text is hashed by itself.
CHUNK = 1_000_000
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_VALUE[_WHITE] = 0
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        base = np.full(max(n, 1024), _STEP, np.uint64)
        base[0] = 1
        _POWERS[0] = np.multiply.accumulate(base)
    return _POWERS[0]


def _sets(data: list[bytes], k: int) -> Iterator[np.ndarray]:
    raw = _LOWER[np.frombuffer(b" ".join([*data, b""]), np.uint8)]
    white = _WHITE[raw]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        for _ in data:
            yield np.zeros(0, np.uint64)
        return
    sizes = np.diff(np.concatenate([starts, [len(raw)]]))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, sizes)
    words = mix(np.add.reduceat(_VALUE[raw[starts[0] :]] * powers(int(sizes.max()) + 1)[place], starts - starts[0]))
    runs = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        runs = runs * _STEP + words[j : j + len(runs)]
    runs = mix(runs)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            yield np.unique(runs[low : high - k + 1])
        elif high > low:
            whole = np.uint64(high - low)
            for word in words[low:high]:
                whole = whole * _STEP + word
            yield mix(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; the whole sequence where it is shorter.

    A-Z count as a-z; words are runs of anything but space and the controls 9 to 13; empty for
    null and for texts without a word.
    """
    with np.errstate(over="ignore"):
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            if held and size + len(data) > CHUNK:
                yield from _sets(held, k)
                held, size = [], 0
            held.append(data)
            size += len(data)
        if held:
            yield from _sets(held, k)
