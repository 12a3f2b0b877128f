"""Byte-level BPE with forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can't be merged across, so a cut
between the two is certain.  Texts are cut at all such pairs (where the cut leaves the splitting
pattern's matches alone as well), the fragments are encoded independently, and their ids are
concatenated.  Fragments repeat far more than texts do, so each task keeps a bounded cache of them.

Null texts are empty and have no ids.  Very long texts are cut like others; a long run of white space,
on which the splitting pattern would look ahead without end, is a match of its own and goes to the
merges directly.  Repeated rows are encoded row by row, an empty table gives an empty result, and
other columns, whatever their names, are not read (`encoded` and `decoded` keep them, but for one
named like their result).  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from variantlab.llm.arrays import SPACE, chunks, utf8

#: Fragments that a task keeps, and the most bytes of one; further and longer ones are encoded each time.
CACHE, KEPT = 400_000, 64

#: The pattern that byte-level vocabularies split by, as the vocabulary file's `use_regex` names it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space from so many characters on is encoded without the pattern.
_LONG_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}+")


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        byte = _byte_of()
        raw = lambda token: bytes(byte[c] for c in token)
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        single = [bytes([b]) for b in range(256)]
        merged = [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        order = [*single, *merged]
        self.ids = np.array([vocabulary[t] for t in order], "<u4")
        self.merge = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.tokens = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        for text, i in special.items():
            self.tokens[i] = text.encode()
        self.certain = self._certain(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.cache = cache

    @staticmethod
    def _certain(vocabulary: dict[bytes, int]) -> np.ndarray:
        """[left, right]: a cut between these bytes is certain."""
        certain = np.ones((256, 256), bool)
        for token in vocabulary:
            for a, b in zip(token, token[1:]):
                certain[a, b] = False
        certain[:, 0x80:0xC0] = False  # inside a character
        certain[SPACE] = False  # the pattern looks ahead from white space
        certain[:, 0x27] = False  # an apostrophe may join what follows it
        return certain.reshape(-1)

    def _cuts(self, block: np.ndarray) -> np.ndarray:
        """Places of all certain cuts in some bytes."""
        sure = self.certain[block[:-1].astype(np.uint16) << 8 | block[1:]]
        if len(block) > 1 and int(block.max()) >= 0x80:  # the pattern looks ahead from wide spaces too
            a, b, c = block[:-2], block[1:-1], block[2:]
            two = np.flatnonzero((block[:-1] == 0xC2) & ((block[1:] == 0x85) | (block[1:] == 0xA0))) + 1
            quad = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            other = (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE1) & (b == 0xA0) & (c == 0x8E) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            ends = np.concatenate([two, np.flatnonzero(quad | other) + 2])
            sure[ends[ends < len(sure)]] = False
        return np.flatnonzero(sure) + 1

    def fragment(self, piece: bytes) -> bytes:
        """The ids of a fragment as little-endian unsigned 32-bit integers."""
        if len(piece) <= KEPT:
            out = self.ids[self.merge.encode_ordinary(piece.decode())].tobytes()
            if len(self.known) < self.cache:
                self.known[piece] = out
            return out
        text, at, out = piece.decode(), 0, []
        for m in _LONG_SPACE.finditer(text):
            out += self.merge.encode_ordinary(text[at : m.start()])
            # the last of the run goes with what follows it
            at = m.end() if m.end() == len(text) else m.end() - 1
            out += self.merge._core_bpe.encode_single_piece(text[m.start() : at].encode())
        out += self.merge.encode_ordinary(text[at:])
        return self.ids[out].tobytes()

    def _plain(self, text: bytes, cuts: list[int]) -> bytes:
        known, fragment = self.known, self.fragment
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        return b"".join([known.get(p) or fragment(p) for p in pieces])

    def _special(self, text: bytes) -> bytes:
        out = []
        for part in self.split_special.split(text.decode()):
            out.append(self.special[part] if part in self.special else self.encode(part.encode()))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8; strings of special tokens in it get their ids."""
        return self.encode_all(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        out = []
        for a, b in chunks(offsets):
            block = data[offsets[a] : offsets[b]]
            whole, edges = block.tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
            cuts = self._cuts(block)
            at = np.searchsorted(cuts, np.array(edges), "left").tolist()
            cuts = cuts.tolist()
            for i in range(b - a):
                start, end = edges[i], edges[i + 1]
                text = whole[start:end]
                if self.split_special and any(s.encode() in text for s in self.special) and text.decode() not in self.special:
                    out.append(self._special(text))
                elif text and text.decode() in self.special:
                    out.append(self.special[text.decode()])
                elif not text:
                    out.append(b"")
                else:
                    own = [c - start for c in cuts[at[i] : at[i + 1]] if c > start]
                    out.append(self._plain(text, [0, *own, end - start]))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8; what isn't a character becomes the replacement character."""
        joined = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def encode_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = coder.encode_all(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with the column `ids`, an array of ints; a column of that name is replaced."""
    path = path or public_path()
    rest = [c for c in docs.columns if c != "ids"]
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode_all(*utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return docs.select(*rest).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows` with the column `decoded`, the text of its column `ids`; null ids are empty."""
    path = path or public_path()
    rest = [c for c in rows.columns if c != "decoded"]
    schema = rows.select(*rest).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.select(*rest).mapInArrow(run, schema)
