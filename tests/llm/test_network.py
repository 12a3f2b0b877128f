"""The network of personal data: other forms on held-out texts, and stretches of any length in one piece."""

from __future__ import annotations

import numpy as np

from variantlab.llm import pii


def sentences(rng, n):
    words = ["order", "invoice", "please", "write", "to", "call", "from", "server", "paid", "with", "the", "in", "3", "on", "12", "May", "room", "41", "years", "1999", "page", "of"]
    return " ".join(rng.choice(words, n))


def luhn_card(rng):
    digits = "".join(map(str, rng.integers(0, 10, 15)))
    return next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))


def made(rng, n):
    out = []
    for _ in range(n):
        kinds = [f"{rng.choice(['joe', 'anna', 'm.meier', 'info'])}{rng.integers(99)}@{rng.choice(['mail', 'firm', 'web'])}.example.{rng.choice(['com', 'org'])}", ".".join(map(str, rng.integers(0, 256, 4))), luhn_card(rng), f"+49 ({rng.integers(100, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}"]
        out.append(f"{sentences(rng, 12)} {kinds[rng.integers(4)]} {sentences(rng, 12)}")
    return out


def quality(net, texts, rng):
    """Precision and recall of added spans on texts whose spans all are in other forms."""
    hits = found = real = 0
    pairs = [pii.rewritten(t, 1.0, rng) for t in texts]
    for (new, spans), (base, every) in zip(pairs, pii.all_spans([t for t, _ in pairs], net)):
        added, wanted = set(every) - set(base), {s for s in spans if s not in base}
        hits, found, real = hits + len(added & wanted), found + len(added), real + len(wanted)
    return hits / max(found, 1), hits / max(real, 1)


def test_other_forms_on_held_out_texts():
    rng = np.random.default_rng(1)
    net = pii.train(*pii.examples(made(rng, 400)))
    held = made(rng, 300)
    precision, recall = quality(net, held, rng)
    assert precision > 0.85 and recall > 0.6, (precision, recall)
    plain = [sentences(rng, 40) for _ in range(200)]
    assert sum(len(every) for _, every in pii.all_spans(plain, net)) <= 4


def whole(texts, net):
    """All windows' scores in one array, one pass for each stretch."""
    out = []
    for text in texts:
        x = pii.classed(text)
        own, found = pii.windows_of(text, x).tolist(), []
        padded = np.pad(x, (0, pii.WINDOW), constant_values=6)
        total, weight = np.zeros((len(padded), pii.TAGS)), np.zeros((len(padded), 1))
        for k in own:
            a = k * pii.STEP
            total[a : a + pii.WINDOW] += net.emissions(padded[None, a : a + pii.WINDOW])[0] * pii._EDGE
            weight[a : a + pii.WINDOW] += pii._EDGE
        covered = weight[: len(text), 0] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            tags = net.decode([total[a:b] / weight[a:b]])[0]
            t = 0
            while t < len(tags):
                start, kind = t, (tags[t] - 1) // 2
                t += 1
                if tags[start]:
                    while t < len(tags) and tags[t] == 2 + 2 * kind:
                        t += 1
                    found.append((int(kind), int(a + start), int(a + t)))
        out.append(found)
    return out


def test_stretches_are_whole_in_any_batch(monkeypatch):
    rng = np.random.default_rng(4)
    net = pii.Tagger(7)
    net.p["out"] *= 3
    texts = ["", "no", "1", *["".join(rng.choice(list("0123456789 ab.@-+()"), int(n))) for n in rng.integers(1, 700, 40)], "7" * 5000, "x" * 100 + "9" * 3000 + "y" * 300 + "8" * 70, "a (at) b (dot) org"]
    expected = whole(texts, net)
    assert sum(map(len, expected)) > 100
    for many in (1, 2, 3, 7, 64, 2048):
        monkeypatch.setattr(pii, "MANY", many)
        assert pii.found_spans(texts, net) == expected, many


def test_nothing_to_learn():
    net = pii.train(*pii.examples(["no data here 12", ""]))
    assert pii.all_spans(["call 030 1234567 or 4 5 6"], net)[0][1] == []
