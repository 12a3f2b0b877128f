"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  Their spans
in at most SAMPLE documents (the first in the order of a hash of doc_id), as they are and rewritten in
ways that the patterns miss, are the labels that the network learns from; of the windows of those
texts, wherever they stand, it takes at most WINDOWS.  It then reads every text in overlapping
windows around the characters that such data can't do without: a digit, an at sign, or a bracketed
word for one of the marks, as in `name (at) host (dot) org`.  Numbers in words are not looked at.  The
windows' scores are reconciled by a weight that falls towards a window's edges, and one Viterbi pass
over each covered stretch, however long, decodes them.  What it finds is added where it is well formed
and touches no base span.

Null and empty texts have no spans.  Texts are read whole and in linear time; windows are scored in
batches of a fixed size, and of a long stretch only a byte for each tag and character is held.
Repeated rows and rows without doc_id are judged row by row, and nothing is shuffled.  An empty table
gives an empty result, and a table without personal data an untrained network that adds nothing.
`report` reads no other columns, `redacted` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents and windows that training takes at most; length and step of windows; batch of windows in training and in use; steps.
SAMPLE, WINDOWS, WINDOW, STEP, BATCH, MANY, STEPS = 1500, 30_000, 64, 32, 64, 2048, 250
EMBED, HIDDEN, TAGS = 12, 16, 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A mark of an address as a word in brackets.
_MARK = r"\s?[(\[{<]\s?(?:%s)\s?[)\]}>]\s?"
_AT, _DOT = re.compile(_MARK % "at|arroba" + r"|\s?@\s?", re.I), re.compile(_MARK % "dot|punkt|punto|point" + r"|\s?\.\s?", re.I)
_WORDED = r"[(\[{<]\s?(?:at|arroba|dot|punkt|punto|point)\s?[)\]}>]"
_NEEDED = re.compile(f"[0-9@]|(?i:{_WORDED})")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"[0-9]+(?:\s?[.-]\s?[0-9]+){3}")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def valid(kind: str, text: str) -> bool:
    """Whether a match of a base pattern stands."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(octet, text.split(".")))
    n = len(digits := digits_of(text))
    return 9 <= n <= 15 if kind == "phone" else 13 <= n <= 19 and luhn(digits)


def well_formed(kind: str, text: str) -> bool:
    """Whether what the network found is personal data of its kind in another form."""
    if kind == "email":
        return _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))) is not None
    if kind == "ip":
        return _PARTS.fullmatch(text) is not None and all(map(octet, re.findall("[0-9]+", text)))
    return valid(kind, text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each at sign, so in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            yield low, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not _NEEDED.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m.group())]
    return out


def _classes() -> np.ndarray:
    """The class of each character up to 128, which stands for all others."""
    out = np.zeros(129, np.int64)
    out[ord("0") : ord("9") + 1] = 1
    out[ord("a") : ord("f") + 1], out[ord("g") : ord("z") + 1] = 2, 3
    out[ord("A") : ord("Z") + 1] = 4
    out[128] = 5
    out[[9, 10, 11, 12, 13]] = 6
    marks = [c for c in range(0x20, 0x7F) if not chr(c).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


_CLASS = _classes()
CLASSES = int(_CLASS.max()) + 1


def classed(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Characters that stretches of like length are decoded together in.
PADDED = 200_000


class Path:
    """Viterbi's pass over one stretch that comes in parts."""

    def __init__(self, begin: np.ndarray, trans: np.ndarray) -> None:
        self.begin, self.trans = begin, trans
        self.best: np.ndarray | None = None
        self.back: list[np.ndarray] = []

    def feed(self, scores: np.ndarray) -> None:
        back, at, best = np.zeros(scores.shape, np.int8), 0, self.best
        if best is None:
            best, at = self.begin + scores[0], 1
        for t in range(at, len(scores)):
            step = best[:, None] + self.trans
            back[t] = step.argmax(0)
            best = step.max(0) + scores[t]
        self.best = best
        self.back.append(back)

    def tags(self) -> np.ndarray:
        back = np.concatenate(self.back)
        out = np.empty(len(back), np.int8)
        tag = int(self.best.argmax())
        for t in range(len(back) - 1, -1, -1):
            out[t] = tag
            tag = int(back[t, tag])
        return out


class Tagger:
    """The network: emission scores from a bidirectional LSTM, and transitions between tags."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.p = {"embed": rng.standard_normal((CLASSES, EMBED)) * 0.5, "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "begin": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"w{d}": init(EMBED + HIDDEN, 4 * HIDDEN), f"c{d}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states [time, window, HIDDEN] of embedded windows [time, window, EMBED], and what backward needs."""
        w, c = self.p[f"w{d}"], self.p[f"c{d}"]
        h = s = np.zeros((x.shape[1], HIDDEN))
        out, kept = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            g = z @ w + c
            gate, new = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            f, i, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            before, s = s, f * s + i * new
            e = np.tanh(s)
            h = o * e
            out[t] = h
            kept.append((z, f, i, o, new, before, e))
        return out, kept

    def _back(self, grad: np.ndarray, kept: list, d: str, to: dict) -> np.ndarray:
        w = self.p[f"w{d}"]
        dx = np.empty((*grad.shape[:2], EMBED))
        dh = ds = 0.0
        for t in range(len(grad) - 1, -1, -1):
            z, f, i, o, new, before, e = kept[t]
            dh = grad[t] + dh
            ds = ds + dh * o * (1 - e * e)
            dg = np.concatenate([ds * before * f * (1 - f), ds * new * i * (1 - i), dh * e * o * (1 - o), ds * i * (1 - new * new)], axis=1)
            to[f"w{d}"] += z.T @ dg
            to[f"c{d}"] += dg.sum(0)
            dz = dg @ w.T
            dx[t], dh, ds = dz[:, :EMBED], dz[:, EMBED:], ds * f
        return dx

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores [window, time, TAGS] of classes [window, time]."""
        e = self.p["embed"][x.T]
        both = np.concatenate([self._run(e, "f")[0], self._run(e[::-1], "b")[0][::-1]], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The CRF's mean negative log-likelihood of tags y, and its gradient."""
        p, n = self.p, len(x)
        e = p["embed"][x.T]
        hf, kf = self._run(e, "f")
        hb, kb = self._run(e[::-1], "b")
        both = np.concatenate([hf, hb[::-1]], axis=2)
        s = both @ p["out"] + p["bias"]
        y = y.T
        size, rows = len(s), np.arange(n)
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        total = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha[0] = p["begin"] + s[0]
        for t in range(1, size):
            alpha[t] = total(alpha[t - 1][:, :, None] + p["trans"], 1) + s[t]
        for t in range(size - 2, -1, -1):
            beta[t] = total(p["trans"] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = total(alpha[-1], 1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        ds = np.exp(alpha + beta - z[None, :, None])
        gold = p["begin"][y[0]] + sum(s[t, rows, y[t]] for t in range(size))
        grad["begin"] += ds[0].sum(0)
        np.add.at(grad["begin"], y[0], -1)
        for t in range(1, size):
            gold = gold + p["trans"][y[t - 1], y[t]]
            grad["trans"] += np.exp(alpha[t - 1][:, :, None] + p["trans"] + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(grad["trans"], (y[t - 1], y[t]), -1)
        ds[np.arange(size)[:, None], rows[None, :], y] -= 1
        grad["out"] += both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS)
        grad["bias"] += ds.sum((0, 1))
        dboth = ds @ p["out"].T
        de = self._back(dboth[:, :, :HIDDEN], kf, "f", grad) + self._back(dboth[::-1, :, HIDDEN:], kb, "b", grad)[::-1]
        np.add.at(grad["embed"], x.T, de)
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def path(self) -> Path:
        return Path(self.p["begin"], self.p["trans"])

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of stretches of scores [time, TAGS]; stretches of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        order, at = sorted(range(len(scores)), key=lambda i: -len(scores[i])), 0
        while at < len(order):
            size = len(scores[order[at]])
            own = order[at : at + max(1, min(256, PADDED // max(size, 1)))]
            at += len(own)
            padded = np.zeros((len(own), size, TAGS))
            for r, i in enumerate(own):
                padded[r, : len(scores[i])] = scores[i]
                padded[r, len(scores[i]) :, 1:] = -1e9
            best, back = self.p["begin"] + padded[:, 0], np.empty((size, len(own), TAGS), np.int8)
            for t in range(1, size):
                step = best[:, :, None] + self.p["trans"]
                back[t] = step.argmax(1)
                best = step.max(1) + padded[:, t]
            tag = np.empty((size, len(own)), np.int64)
            tag[-1] = best.argmax(1)
            for t in range(size - 1, 0, -1):
                tag[t - 1] = back[t, np.arange(len(own)), tag[t]]
            for r, i in enumerate(own):
                out[i] = tag[: len(scores[i]), r]
        return out


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for k, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def _rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """A form of personal data that the patterns miss."""
    digits = digits_of(text)
    if kind == 0:
        form = rng.integers(5)
        if form < 2:
            a, b = ("()", "[]", "{}")[rng.integers(3)]
            gap = ("", " ")[rng.integers(2)]
            left, _, right = text.partition("@")
            dotted = right.replace(".", f"{gap}{a}dot{b}{gap}") if form else right
            return f"{left}{gap}{a}at{b}{gap}{dotted}"
        return text.replace("@", [" @ ", " @", "@ "][form - 2])
    if kind == 1:
        return text.replace(".", [". ", " . ", "-"][rng.integers(3)])
    if kind == 2:
        mark = [".", "/", "  ", "_"][rng.integers(4)]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"00{digits}"][rng.integers(4)]


def rewritten(text: str, share: float, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a share of its base spans in other forms, and where all of them are then."""
    parts, spans, at, size = [], [], 0, 0
    for k, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a < at:
            continue
        new = _rewritten(k, text[a:b], rng) if rng.random() < share else text[a:b]
        parts += [text[at:a], new]
        size += a - at
        spans.append((k, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*parts, text[at:]]), spans


def windows_of(text: str, x: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a needed character; window k starts at k * STEP."""
    marks = (x == 1) | (x == _CLASS[ord("@")])
    worded = [m.start() for m in _NEEDED.finditer(text) if m.end() > m.start() + 1] if any(c in text for c in "([{<") else []
    at = np.concatenate([np.flatnonzero(marks), np.array(worded, np.int64)]) // STEP
    return np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))


#: Shares of spans that are rewritten in the copies of a text that training sees.
SHARES = (0.0, 0.5, 1.0)


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of all windows around needed characters, of each text and its rewritten copies."""
    xs, ys = [], []
    for text in texts:
        rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        for share in SHARES:
            new, spans = rewritten(text, share, rng)
            x, y = classed(new), tags_of(len(new), spans)
            own = windows_of(new, x)
            pad = max(0, WINDOW - len(x))
            x, y = np.pad(x, (0, pad), constant_values=6), np.pad(y, (0, pad))
            at = np.minimum(own * STEP, len(x) - WINDOW)[:, None] + np.arange(WINDOW)
            xs.append(x[at])
            ys.append(y[at])
            if not spans:
                break
    return np.concatenate(xs).reshape(-1, WINDOW) if xs else np.zeros((0, WINDOW), np.int64), np.concatenate(ys).reshape(-1, WINDOW) if ys else np.zeros((0, WINDOW), np.int64)


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 5) -> Tagger:
    """A tagger from windows of classes and tags."""
    net, rng = Tagger(seed), np.random.default_rng(seed)
    if not (len(y) and y.any()):
        net.p["out"][:], net.p["bias"][0] = 0.0, 1.0  # nothing to learn: no span anywhere
        return net
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        rows = rng.integers(len(x), size=BATCH)
        _, grad = net.loss(x[rows], y[rows])
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


#: The weight of a window's scores falls towards its edges; where two windows overlap weights add up to 1.
_EDGE = (np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)) / (STEP + 1))[:, None]


def found_spans(texts: list[str], net: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text, over all windows that hold a needed character.

    Windows come in batches of MANY.  A stretch of overlapping windows that ends in its batch is
    decoded with others; one that doesn't is decoded as its batches come.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ready: list[tuple[int, int, np.ndarray]] = []  # text, first character, scores
    path: Path | None = None  # of a stretch that an earlier batch began
    began = 0

    def take(i: int, low: int, tags: np.ndarray) -> None:
        kind = (tags.astype(np.int64) + 1) // 2  # 0: no span
        marks = np.flatnonzero((np.diff(np.concatenate([[0], kind, [0]])) != 0) | np.concatenate([tags % 2 == 1, [False]]))
        for a, b in zip(marks, marks[1:]):
            if tags[a]:
                out[i].append((int(kind[a]) - 1, low + int(a), low + int(b)))

    def windows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, text in enumerate(texts):
            if _NEEDED.search(text):
                x = classed(text)
                own = windows_of(text, x)
                x = np.pad(x, (0, WINDOW), constant_values=6)
                for a in range(0, len(own), MANY):
                    part = own[a : a + MANY]
                    yield i, part, x[part[:, None] * STEP + np.arange(WINDOW)]

    def flush(held: list, last: bool) -> list:
        nonlocal path, began
        text = np.concatenate([np.full(len(k), i) for i, k, _ in held])
        place, x = np.concatenate([k for _, k, _ in held]), np.concatenate([x for _, _, x in held])
        raw = net.emissions(x)
        half = raw * _EDGE
        joined = np.zeros(len(x) + 1, bool)
        joined[1:-1] = (text[1:] == text[:-1]) & (place[1:] == place[:-1] + 1)
        front = raw[:, :STEP].copy()
        at = np.flatnonzero(joined[1:-1]) + 1
        front[at] = half[at, :STEP] + half[at - 1, STEP:]
        starts = np.flatnonzero(~joined)
        keep = []
        for a, b in zip(starts, starts[1:]):
            i, low = int(text[a]), int(place[a]) * STEP
            most = len(texts[i]) - (began if path is not None and a == 0 else low)
            if b == len(x) and not last:  # it may go on: its last window is scored again with the next ones
                if a < b - 1:
                    own = front[a : b - 1].reshape(-1, TAGS)
                    if path is None or a:
                        path, began = net.path(), low
                        path.feed(own)
                    else:
                        path.feed(own[STEP:])
                    keep = [(i, place[b - 2 : b], x[b - 2 : b])]
                else:
                    keep = [(i, place[a:b], x[a:b])]
            else:
                own = np.concatenate([front[a:b].reshape(-1, TAGS), raw[b - 1, STEP:]])
                if path is not None and a == 0:
                    path.feed(own[STEP:])
                    take(i, began, path.tags()[:most])
                    path = None
                else:
                    ready.append((i, low, own[:most]))
        for (i, low, _), tags in zip(ready, net.decode([r[2] for r in ready])):
            take(i, low, tags)
        ready.clear()
        return keep

    held, size = [], 0
    for part in windows():
        held.append(part)
        size += len(part[1])
        if size >= MANY:
            held = flush(held, False)
            size = sum(len(k) for _, k, _ in held)
    if held:
        flush(held, True)
    return [sorted(found, key=lambda s: s[1]) for found in out]


def all_spans(texts: list[str], net: Tagger) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, by kind and start."""
    out = []
    for text, found in zip(texts, found_spans(texts, net)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        more = []
        for k, a, b in found:
            a += len(text[a:b]) - len(text[a:b].lstrip())
            b -= len(text[a:b]) - len(text[a:b].rstrip())
            free = all(b <= x or a >= y for x, y in taken)
            if a < b and free and well_formed(KINDS[k], text[a:b]):
                more.append((k, a, b))
                taken.append((a, b))
        out.append((base, sorted([*base, *more])))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fitted(docs: DataFrame, most: int = SAMPLE, windows: int = WINDOWS) -> Tagger:
    """A network from at most `windows` windows of at most `most` documents, those first in the order of hashes of their places.

    Tasks cut the texts; the driver gets windows alone, so no long or repeated text can fill it.
    """
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    chosen = some.select("doc_id").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(most).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x, y = (v.astype(np.uint8) for v in examples([text]))
                place = np.arange(len(x)) << 32 | zlib.crc32(text.encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, y))], ["place", "x", "y"])

    rows = some.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "place long, x binary, y binary")
    # by place, so that copies of one window don't come together
    table = rows.orderBy(F.xxhash64(F.lit(17), "place"), "x", "y").limit(windows).toArrow()
    x, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64) for c in "xy")
    return train(x, y)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = all_spans([x or "" for x in batch.column("text").to_pylist()], shared.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([joined(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, spans], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind, as in <EMAIL>; `n_chars` follows."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                columns = dict(zip(batch.schema.names, batch.columns))
                texts = columns["text"].to_pylist()
                lengths = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i, (_, every) in enumerate(all_spans([x or "" for x in texts], shared.value)):
                    if every:
                        texts[i] = masked(texts[i], every)
                        if lengths is not None:
                            lengths[i] = len(texts[i])
                columns["text"] = pa.array(texts, columns["text"].type)
                if lengths is not None:
                    columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.limit(0).schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced; of overlapping spans the union is, by the kind of the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
