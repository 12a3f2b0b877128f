"""Size-bounded splits of a similarity graph: bounds, planted communities, whole small components, odd rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from variantlab.operators import partition

NODES, LINKS = "id long, size double", "u long, v long, weight double"


def split_of(spark, nodes, links, parts, **settings):
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS)
    got = partition.balanced_split(n, e, parts, **settings)
    return {r.id: r.part for r in got.collect()}, partition.split_report(got, e).first()


def test_a_giant_component_is_cut_between_its_communities(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 240)
    group = {x: i // 60 for i, x in enumerate(ids)}
    links = [(a, b, 1.0) for i, a in enumerate(ids) for b in rng.sample(ids[i // 60 * 60 : i // 60 * 60 + 60], 6)]
    links += [(rng.choice(ids), rng.choice(ids), 1.0) for _ in range(40)] + list(zip(ids, ids[1:], [1.0] * 239))
    part, report = split_of(spark, [(x, 1.0) for x in ids], links, 4, rounds=6, orders=12)
    assert len(part) == 240 and report.n_parts == 4
    assert 57 <= report.smallest and report.largest <= 63
    planted = sum(group[a] != group[b] for a, b, _ in links)
    assert report.cut <= 0.45 * report.weight and report.cut <= 6 * planted  # a random split cuts 0.75


def test_small_components_stay_whole(spark):
    rng = random.Random(4)
    nodes, links, member = [], [], {}
    for c in range(150):
        own = [c * 10 + k for k in range(rng.randint(1, 5))]
        nodes += [(x, float(rng.randint(1, 2))) for x in own]
        links += [(a, b, 2.0) for a, b in zip(own, own[1:])]
        member |= dict.fromkeys(own, c)
    part, report = split_of(spark, nodes, links, 3, slack=0.1, rounds=2, orders=1)
    parts = defaultdict(set)
    for x, c in member.items():
        parts[c].add(part[x])
    assert report.cut == 0 and all(len(p) == 1 for p in parts.values())
    share = sum(s for _, s in nodes) / 3
    assert share * 0.9 <= report.smallest and report.largest <= share * 1.1


@pytest.mark.parametrize("seed", range(200))
def test_allowed_moves_keep_the_bounds(seed):
    rng = random.Random(seed)
    k = rng.randint(2, 5)
    sizes = [rng.uniform(90, 110) for _ in range(k)]
    wanted = {(i, j): rng.uniform(0, 60) for i in range(k) for j in range(k) if i != j and rng.random() < 0.7}
    low, high = min(sizes) - 3, max(sizes) + 3
    out = partition._allowed(wanted, sizes, low, high)
    assert all(0 <= n <= wanted[m] + 1e-9 for m, n in out.items())
    for j in range(k):
        come, go = sum(n for (_, to), n in out.items() if to == j), sum(n for (by, _), n in out.items() if by == j)
        assert low - 1e-6 <= sizes[j] + come - go <= high + 1e-6
    moved = {m: n * rng.random() for m, n in out.items()}
    made = partition._within(moved, sizes, low, high)
    for j in range(k):
        come, go = (sum(moved[m] for m in made if m[side] == j) for side in (1, 0))
        assert low - 1e-6 <= sizes[j] + come - go <= high + 1e-6


def test_odd_rows(spark):
    nodes = [(1, None), (1, 1.0), (2, 1.0), (None, 5.0), (3, 0.0)]
    links = [(1, 1, 1.0), (1, 99, 1.0), (1, 2, None), (2, 3, -1.0), (None, 2, 1.0), (2, 1, 0.5), (1, 2, 0.5)]
    part, report = split_of(spark, nodes, links, 2, rounds=2, orders=1)
    assert set(part) == {1, 2, 3} and set(part.values()) <= {0, 1} and report.weight == 1.0
    assert split_of(spark, [], [], 3, rounds=1, orders=1)[0] == {}
