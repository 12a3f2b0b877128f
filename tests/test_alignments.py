"""Profiles in blocks against the plain ones; alignments put together from pairwise ones."""

from __future__ import annotations

import random

import numpy as np
import pytest

from variantlab.functions.expr import RESIDUES
from variantlab.operators import alignment


@pytest.mark.parametrize("bounds", [(4096, 1 << 22), (3, 20 * 40)])
def test_profiles_in_blocks_are_the_plain_ones(spark, monkeypatch, bounds):
    monkeypatch.setattr(alignment, "ROWS", bounds[0])
    monkeypatch.setattr(alignment, "CELLS", bounds[1])
    rng = random.Random(6)
    rows = []
    for prot, n, width in (("a", 1, 7), ("b", 9, 30), ("c", 40, 23), ("gaps", 3, 4)):
        for r in range(n):
            text = "-" * width if prot == "gaps" else "".join(rng.choice(RESIDUES[:6] + "--xé") for _ in range(width - (r % 3 == 1)))
            rows.append((prot, r, text))
    rows.append((None, 0, "ARND"))
    rows.append(("b", 9, None))
    df = spark.createDataFrame(rows, "prot_id string, row_nr int, aligned string")
    got = {(r.prot_id, r.pos, r.aa): (r.score, r.n_rows) for r in alignment.profiles(df).collect()}
    place = {c: i for i, c in enumerate(RESIDUES)}
    seen = 0
    for prot in ("a", "b", "c", "gaps", None):
        own = [t or "" for p, _, t in rows if p == prot]
        width = max(map(len, own))
        codes = np.array([[place.get(c.upper(), -1) for c in t.ljust(width, "-")] for t in own])
        score = alignment.profile(codes)
        for pos in range(width):
            for i, aa in enumerate(RESIDUES):
                assert got[prot, pos, aa] == (pytest.approx(score[pos, i], abs=1.1e-3), (codes[:, pos] >= 0).sum())
                seen += 1
    assert seen == len(got)
    assert alignment.profiles(df.limit(0)).collect() == []


def test_assembly_keeps_every_residue(spark):
    rng = random.Random(9)
    seeds = [(p, "".join(rng.choices(RESIDUES, k=rng.randint(1, 30)))) for p in "abc"]
    pairs = []
    for prot, seed in seeds:
        for h in range(12):
            q, t = [], []
            for c in [*seed, ""]:
                for _ in range(rng.choice([0, 0, 0, 1, 3])):
                    q.append("-")
                    t.append(rng.choice(RESIDUES))
                if c:
                    q.append(c)
                    t.append(rng.choice([c, "-", rng.choice(RESIDUES)]))
            pairs.append((prot, f"h{h:02d}", "".join(q), "".join(t)))
    pairs += [("d", "nobody", "A", "A"), ("a", "h00", seeds[0][1], seeds[0][1]), ("a", "h00", seeds[0][1], seeds[0][1])]
    columns = "prot_id string, hit_id string, q_aln string, t_aln string"
    known = spark.createDataFrame([*seeds, ("alone", "MK")], "prot_id string, seq string")
    got = alignment.assembled(known, spark.createDataFrame(pairs, columns)).collect()
    rows = {(r.prot_id, r.row_nr): r for r in got}
    assert len(rows) == len(got) == 3 * 13 + 2 + 1 and rows["alone", 0].aligned == "MK"
    for prot, seed in seeds:
        own = sorted((r for r in got if r.prot_id == prot), key=lambda r: r.row_nr)
        assert [r.row_nr for r in own] == list(range(len(own))) and len({len(r.aligned) for r in own}) == 1
        assert own[0].aligned.replace("-", "") == seed
        of = sorted((h, q, t) for p, h, q, t in pairs if p == prot)
        assert len(of) == len(own) - 1
        for (name, q, t), r in zip(of, own[1:]):
            assert r.seq_id == name and r.aligned.replace("-", "") == t.replace("-", "")
            # the seed's residues stand where the pair put them
            assert [c for s, c in zip(own[0].aligned, r.aligned) if s != "-"] == [c for s, c in zip(q, t) if s != "-"]
        width = sum(max(len(run) for run in runs) for runs in zip(*[insertions(q) for _, q, _ in of]))
        assert len(own[0].aligned) == len(seed) + width
    with pytest.raises(Exception, match="another sequence"):
        alignment.assembled(known, spark.createDataFrame([("a", "x", "W" + seeds[0][1], "A")], columns)).collect()


def insertions(query):
    """The runs of gaps before each residue, and at the end."""
    out, run = [], ""
    for c in query:
        if c == "-":
            run += c
        else:
            out.append(run)
            run = ""
    return [*out, run]
