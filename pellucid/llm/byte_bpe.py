"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token with which an encoding of that prefix ends.
Storing it for each prefix gives the encoding of any prefix by walking back, makes an append exact (only new
prefixes are computed) and lets an edit keep all prefixes before it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pellucid.llm._common import local_path, pick, slices, texts, to_batch

#: Pieces of the newer of the two generations of encodings that a worker keeps.
KEPT_PIECES = 300_000
#: Tested pairs of tokens that it keeps, across tasks.
KEPT_FITS = 400_000


class Vocabulary:
    """Ranks of byte strings, and for each token the two tokens whose merge makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        #: tokens that merging reaches, as nested dicts by byte with the token under -1; the others appear only as whole pieces
        self.trie: dict = {}
        for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(raw) == 1:
                self.parts[rank] = (rank, rank)
                self._reach(raw, rank)
            elif (pair := self._last_merge(raw, rank)) is not None:
                self.parts[rank] = pair
                self._reach(raw, rank)

    def _reach(self, raw: bytes, rank: int) -> None:
        node = self.trie
        for byte in raw:
            node = node.setdefault(byte, {})
        node[-1] = rank

    def _last_merge(self, raw: bytes, below: int) -> tuple[int, int] | None:
        """Encodes raw with ranks under its own: the two parts left, or None if more are."""
        ids = merge(raw, self.ranks, below)
        return (ids[0], ids[1]) if len(ids) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Do the two tokens stay apart, next to each other, under all merges?

        Undoing merges from the latest to the earliest on the sides that touch: no pair that meets on the way
        may merge earlier than the merge that is being undone.
        """
        known = self._fits.get(left << 32 | right)
        if known is None:
            if len(self._fits) > KEPT_FITS:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        # `before`: a pair counts only if it merges before this rank (ties: the left pair goes first)
        before = 1 << 62
        while True:
            joined = self.ranks.get(self.bytes[a] + self.bytes[b])
            if joined is not None and joined < before:
                return False
            (_, a_right), (b_left, _) = self.parts[a], self.parts[b]
            whole_a, whole_b = a_right == a, b_left == b
            if whole_a and whole_b:
                return True
            if whole_b or not whole_a and a > b:
                before, a = a, a_right
            else:
                before, b = b + 1, b_left

    def prefixes(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of the encoding of every prefix; `known` holds those of the shorter prefixes."""
        last = list(known or ())
        done, size = len(last), len(piece)
        last += [-1] * (size - done)
        known_fits, fits, root = self._fits.get, self.fits, self.trie
        for start in range(max(0, done - self.longest + 1), size):
            left, node = last[start - 1] << 32, root
            for end in range(start, size):
                node = node.get(piece[end])
                if node is None:
                    break
                # tokens that start here, shortest first; a prefix that has its last token needs no other
                if last[end] < 0 and (token := node.get(-1)) is not None:
                    if start:
                        fit = known_fits(left | token)
                        if not (fits(left >> 32, token) if fit is None else fit):
                            continue
                    last[end] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece, from the end."""
        out, end, sizes = [], len(last), self.sizes
        while end:
            out.append(token := last[end - 1])
            end -= sizes[token]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """As tiktoken encodes one match of the pattern: a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.prefixes(piece))


def merge(raw: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[int]:
    """The definition of BPE: again and again, the leftmost adjacent pair of the lowest rank merges."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best = min((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], 1 << 62)) is not None)
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


class PieceBuffer:
    """One piece of text that grows or changes: prefixes before the first changed byte are kept."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.last = self.vocabulary.prefixes(self.piece, self.last)

    def splice(self, start: int, end: int, new: bytes) -> None:
        self.last, self.piece = self.last[:start], self.piece[:start] + new + self.piece[end:]
        self.last = self.vocabulary.prefixes(self.piece, self.last)

    @property
    def ids(self) -> list[int]:
        return self.vocabulary.encode_piece(self.piece) if self.piece in self.vocabulary.ranks else self.vocabulary.walk(self.last)


@lru_cache(2)
def load(path: str) -> Vocabulary:
    """A .tiktoken rank file; a bare name means a file of the public tokenizers on each machine."""
    with open(local_path(path), "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = load(path)
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.packed = {t: t.to_bytes(4, "little") for t in self.vocabulary.bytes}
        self.table = [self.vocabulary.bytes.get(i, b"") for i in range(max(self.vocabulary.bytes, default=-1) + 1)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        kept, packed, pieces = self.kept, self.packed, self.find(text)
        for p in set(pieces).difference(kept):
            ids = self.older.get(p)
            if ids is None:
                ids = b"".join([packed[t] for t in self.vocabulary.encode_piece(p.encode("utf-8", "surrogatepass"))])
            kept[p] = ids
        out = b"".join([kept[p] for p in pieces])
        if len(kept) > KEPT_PIECES:
            self.older, self.kept = {k: v for k, v in kept.items() if len(k) < 64}, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def default_codec(path: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path, pattern or public_tokenizers.PATTERN)


ENCODED = "doc_id long, ids binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(docs: DataFrame, path: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text; nothing is shuffled.

    Each match of the pattern is encoded by itself, without special tokens. Null text counts as empty: no
    ids. Very long texts are encoded whole, one match of the pattern after the other. Ties between merges do
    not arise: ranks differ. Repeated rows get equal results; null ids stay null; other columns, whatever their
    names, are not looked at; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        codec = default_codec(path, pattern)
        for part in slices(batches):
            yield to_batch(schema, {"doc_id": part.column(0), "ids": [codec.encode(t) for t in texts(part)]})

    return pick(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, path: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and data (the decoded bytes) of encoded rows; null ids decode to nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        codec = default_codec(path)
        for part in slices(batches, "ids"):
            yield to_batch(schema, {"doc_id": part.column(0), "data": [codec.decode(x or b"") for x in part.column(1).to_pylist()]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def roundtrip(docs: DataFrame, path: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes the ids, in one pass: counts and digests of both for every row.

    Nulls, empty and very long texts, repeated rows, other columns and empty tables as with encode_texts.
    """

    def run(batches):
        codec = default_codec(path, pattern)
        for part in slices(batches):
            ids = [codec.encode(t) for t in texts(part)]
            yield to_batch(RESULT, {
                "doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            })

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
