"""Packing where most pieces can't be paired, and that no exchange is left over."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

from variantlab.llm import packing

SCHEMA = "doc_id long, text string"


def packed_sizes(spark, least, most, n, group):
    rng = random.Random(5)
    docs = [(i, " the" * rng.randrange(least, most)) for i in range(n)]
    return packing.packed(spark.createDataFrame(docs, SCHEMA), group=group).collect()


def test_no_group_grows_where_pieces_cannot_be_paired(spark):
    rows = packed_sizes(spark, 580, 620, 1500, 100)
    assert len(rows) == 1500 and min(r.length for r in rows) > 512
    assert len({r.sequence_id for r in rows}) == 1500
    assert max(Counter(r.sequence_id >> 20 for r in rows).values()) < 200


def test_no_exchange_is_left(spark):
    rows = packed_sizes(spark, 300, 520, 900, 1000)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r.length)
    bins = list(bins.values())
    assert sum(map(len, bins)) == 900 and max(map(sum, bins)) <= 1024 and -(-sum(map(sum, bins)) // 1024) < len(bins)

    def sums(own):
        return [(1, x) for x in own] + [(2, x + y) for x, y in combinations(own, 2)]

    for low, b in ((x, y) for x in bins for y in bins if x is not y and sum(x) <= sum(y) < 1024):
        room = 1024 - sum(b)
        assert not any(x <= room for x in low)
        assert not any(0 < x - y <= room for k, x in sums(low) for m, y in sums(b) if k + m < 4)
