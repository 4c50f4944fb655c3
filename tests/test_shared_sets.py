"""Batches that hold the same large sets of carriers."""

from __future__ import annotations

import random
from itertools import combinations

import cohorts
import pytest

from cohortgate.operators import counts


@pytest.mark.parametrize("frequent_words", [0, 1, 3, 100])
def test_batches_share_frequent_sets(spark, frequent_words):
    """Counts of every batch, whichever of its sets are counted with those of other batches."""
    rng = random.Random(frequent_words)
    carriers = {f"1:{i}:A:C": set(rng.sample(range(640), size)) for i, size in enumerate([400, 300, 90, 5, 4, 3, 2, 1, 1, 0])}
    batches = {f"B{i}": rng.sample(sorted(carriers), rng.randrange(1, 6)) for i in range(60)}
    row = "cpra string, requested_source string, carrier_definition string"
    words = counts.carrier_words(cohorts.table(
        spark, [(v, "array", "het_and_homalt", n, "included") for v, found in carriers.items() for n in found],
        f"{row}, participant_no bigint, decision string",
    ))
    members = cohorts.table(
        spark, [(b, i, v, "array", "het_and_homalt") for b, asked in batches.items() for i, v in enumerate(asked)],
        f"batch_id string, ordinal bigint, {row}",
    )
    got = {r.batch_id: r for r in counts.batch_union(words, members, frequent_words).collect()}
    assert set(got) == set(batches)
    for batch, asked in batches.items():
        one = set().union(*(carriers[v] for v in asked))
        two = set().union(*(carriers[a] & carriers[b] for a, b in combinations(asked, 2)))
        assert (got[batch].combined_carriers, got[batch].overlap_carriers) == (len(one), len(two))
        assert (got[batch].subject, got[batch].distinct_variants) == ("+".join(asked), len(asked))
