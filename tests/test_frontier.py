"""The frontier of a growing ledger against plain hashing."""

from __future__ import annotations

import hashlib
import random

import cohorts
import pytest

from cohortgate.operators import frontier
from cohortgate.operators.frontier import Frontier


def pair(a, b):
    return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def plain_root(level):
    if not level:
        return hashlib.sha256(b"\x01").hexdigest()
    while len(level) > 1:
        level = [pair(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0]


def plain_peaks(leaves):
    out, at = [], 0
    for level in range(40, -1, -1):
        if len(leaves) >> level & 1:
            out.append((level, plain_root(leaves[at : at + 2**level])))
            at += 2**level
    return tuple(sorted(out))


def rows(spark, leaves, first):
    data = list(enumerate(leaves, first))
    random.Random(1).shuffle(data)
    return cohorts.table(spark, data, "seq bigint, leaf string")


def made(count):
    return [hashlib.sha256(str(i).encode()).hexdigest() for i in range(count)]


@pytest.mark.parametrize("steps", [(1, 2, 4), (3, 8), (7, 8, 1030), (1024, 2048, 2049), (5, 1024), (1500, 4000), (6, 7, 7, 13)])
def test_appends_equal_one_pass_and_read_new_leaves_only(spark, steps):
    leaves = made(steps[-1])
    state = Frontier()
    for total in steps:
        new = leaves[state.total : total]
        after = frontier.extended(state, rows(spark, new, state.total), len(new))
        assert after.total == total and after.peaks == plain_peaks(leaves[:total])
        assert frontier.consistent(state, after, spark).first()[0]
        assert frontier.roots(after.frame(spark)).first().root == plain_root(leaves[:total])
        state = after


def test_changed_old_entries_are_not_consistent(spark):
    leaves = made(40)
    changed = ["0" * 64 if i == 9 else leaf for i, leaf in enumerate(leaves)]
    for old_total in (11, 16, 32, 39):
        old = Frontier(old_total, plain_peaks(leaves[:old_total]))
        forged = Frontier(old_total, plain_peaks(changed[:old_total]))
        after = frontier.extended(forged, rows(spark, changed[old_total:], old_total), 40 - old_total)
        assert frontier.consistent(forged, after, spark).first()[0]
        assert not frontier.consistent(old, after, spark).first()[0]
        assert not frontier.consistent(after, old, spark).first()[0]


def test_gaps_and_repeats_stop_an_append(spark):
    leaves = made(3000)
    with pytest.raises(Exception, match="gaps or repeats|missing"):
        frontier.extended(Frontier(), rows(spark, leaves[:2] + leaves[3:5], 0).filter("seq <> 1"), 4)
    with pytest.raises(Exception, match="gaps or repeats|missing"):
        frontier.extended(Frontier(), rows(spark, leaves, 0).filter("seq < 1024 OR seq >= 2048"), 3000)
    with pytest.raises(Exception, match="gaps or repeats|missing"):
        frontier.extended(Frontier(), rows(spark, leaves, 0).filter("seq < 2048"), 3000)


def test_stored_states(spark, tmp_path):
    path = str(tmp_path / "frontiers")
    frontier.save(Frontier(), spark, path)
    assert frontier.latest(spark, path) == Frontier()
    leaves = made(21)
    for total in (6, 21):
        state = frontier.latest(spark, path)
        frontier.save(frontier.extended(state, rows(spark, leaves[state.total : total], state.total), total - state.total), spark, path)
    assert frontier.latest(spark, path).peaks == plain_peaks(leaves)
    assert {r.total: r.root for r in frontier.roots(spark.read.parquet(path)).collect()} == {t: plain_root(leaves[:t]) for t in (6, 21)}
    assert frontier.roots(Frontier().frame(spark)).count() == 0
