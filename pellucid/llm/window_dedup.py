"""Repeated word windows across documents, behind a count-min filter.

Every window of `width` words has an anchor: the leftmost of its `gram` words in a row with the smallest digest.
Equal windows have equal anchors, at as many places at least as there are equal windows, and a text has far
fewer anchors than windows. Tasks count anchors in count-min sketches; the merged sketch therefore overestimates
how often a window occurs, and a window whose anchor it has seen once cannot repeat.

In a second pass only the windows of the other anchors are dealt out, by anchor, and grouped exactly by digests of
64 bits of the anchor and 64 bits of all words. A task collapses equal windows of its own before it sends them, so
one passage that a third of all documents hold costs one row for each slice of text, not for each document.

The sketch takes its size from the bytes of the corpus up to a fixed bound (SKETCH_BITS). Beyond that it lets more
windows through: the second pass moves more, and stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, ship, slices

#: Words of a window and of an anchor.
WIDTH, GRAM = 35, 12
#: Rows of the sketch; the power of two of its cells in all at most (one bit each once merged) and at least; bytes of text for a cell.
SKETCH_ROWS, SKETCH_BITS, LEAST_BITS, BYTES_A_CELL = 2, 30, 16, 4
#: The power of two of the cells that are merged at once; different words that a task remembers.
BLOCK_BITS, REMEMBERED = 21, 500_000
#: Repeated windows that a task gathers before it joins neighbours to runs.
GATHERED = 1_000_000
_B1, _B2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class _Words(dict):
    """Words to places in two arrays of digests; forgets all once it holds REMEMBERED."""

    def __init__(self):
        super().__init__()
        self.both = np.zeros((1 << 12, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.both):
            self.both = np.concatenate([self.both, np.zeros_like(self.both)])
        d = xxhash.xxh3_128_intdigest(word)
        self.both[at] = d & 0xFFFFFFFFFFFFFFFF, d >> 64
        self[word] = at
        return at

    def digests(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = self.both[at]
        return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = tuple(out)
    return _powers[base]


def rolled(digests: np.ndarray, n: int, base: int) -> np.ndarray:
    """A digest of each n in a row: a polynomial in the base, modulo 2**64, mixed."""
    up, down = _power(base, len(digests))
    sums = np.zeros(len(digests) + 1, np.uint64)
    np.cumsum(digests * up[: len(digests)], out=sums[1:])
    h = (sums[n:] - sums[:-n]) * down[: len(digests) - n + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ h >> np.uint64(32)


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the leftmost minimum among each w neighbours."""
    n = len(h) - w + 1
    at, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        size += step
    return at[:n]


def windows(one: np.ndarray, two: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, its digest, digest of all words) of each window; at least `width` words are there."""
    g = rolled(one, gram, _B1)
    at = _leftmost_least(g, width - gram + 1)
    return at, g[at], rolled(two, width, _B2)


def _cells(anchors: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each anchor in each row of a sketch of 2**bits cells a row."""
    return np.stack([(anchors * m) >> np.uint64(64 - bits) for m in _MIX[:SKETCH_ROWS]]).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(row, words) of the texts of a batch; null has none."""
    for i, t in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
        yield i, t.split() if t else []


def _sketch(docs: DataFrame, bits: int, width: int, gram: int) -> DataFrame:
    """row, block, cells: those that anchors of a slice of text fall into, times two, plus one where more than one does."""
    block = min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text"):
            found = []
            for _, words in _texts(batch):
                if len(words) >= width:
                    one, two = known.digests(words)
                    at, g, _ = windows(one, two, width, gram)
                    found.append(g[np.r_[True, at[1:] != at[:-1]]])
            if not found:
                continue
            rows, blocks, cells = [], [], []
            for r, c in enumerate(_cells(np.concatenate(found), bits)):
                c, n = np.unique(c, return_counts=True)
                cuts = np.searchsorted(c, np.arange(0, (1 << bits) + 1, 1 << block))
                packed = ((c & ((1 << block) - 1)) << 1 | (n > 1)).astype(np.uint32)
                for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    rows.append(r), blocks.append(b), cells.append(packed[cuts[b] : cuts[b + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["row", "block", "cells"])

    return docs.select("text").mapInArrow(run, "row int, block int, cells binary")


def _merged(sketches: DataFrame, bits: int) -> DataFrame:
    """row, block, twice: a bit for each cell that is met twice or more. Sorted and streamed: a task holds one block."""
    block = min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(1 << block, np.uint8)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["row", "block", "twice"])
        for batch in batches:
            for row, number, cells in zip(*[c.to_pylist() for c in batch.columns]):
                if (row, number) != at:
                    if at is not None:
                        yield pack()
                    at = row, number
                    counts[:] = 0
                c = np.frombuffer(cells, np.uint32)
                own = c >> 1
                counts[own] = np.minimum(2, counts[own] + 1 + (c & 1))
        if at is not None:
            yield pack()

    return sketches.repartition("row", "block").sortWithinPartitions("row", "block").select("row", "block", "cells").mapInArrow(run, "row int, block int, twice binary")


def sketch_bits(n_bytes: int, most: int = SKETCH_BITS) -> int:
    """The power of two of the cells in a row of the sketch, for a corpus of so many bytes of text."""
    cells = max(1, n_bytes // BYTES_A_CELL)
    return max(LEAST_BITS, min(most, math.ceil(math.log2(cells)))) - 1


def count_min(docs: DataFrame, bits: int, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The merged sketch: for each row the bits of the cells that two places or more fall into, 2**bits / 8 bytes each."""
    merged = Stored(_merged(_sketch(docs, bits, width, gram), bits), "sketch")
    size = 1 << (min(bits, BLOCK_BITS) - 3)
    out = np.zeros((SKETCH_ROWS, 1 << (bits - 3)), np.uint8)
    for r in merged.df.collect():  # SKETCH_ROWS << bits bits at most, whatever the corpus
        out[r["row"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    merged.drop()
    return out


def _estimated_repeated(sketch: np.ndarray, bits: int, anchors: np.ndarray) -> np.ndarray:
    alive = np.ones(len(anchors), bool)
    for row, c in zip(sketch, _cells(anchors, bits)):
        alive &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return alive


_SENT = pa.schema([("anchor", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("digests", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])


def _candidates(docs: DataFrame, sketch, bits: int, width: int, gram: int) -> DataFrame:
    """anchor, did, th, start, digests: windows in a row that share an anchor met twice or more; the first of its kind in a slice only.

    What a slice finds repeated within itself comes as marks (pairs of first and last start), under an anchor of the document's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text"):
            ids, hashes = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            parts = []
            for i, words in _texts(batch):
                if len(words) < width:
                    continue
                one, two = known.digests(words)
                at, g, d = windows(one, two, width, gram)
                new = np.r_[True, at[1:] != at[:-1]]  # an anchor is looked up once for all its windows
                keep = np.flatnonzero(_estimated_repeated(sketch.value, bits, g[new])[np.cumsum(new) - 1])
                if len(keep):
                    parts.append((np.full(len(keep), i), keep, at[keep], g[keep], d[keep]))
            if not parts:
                continue
            doc, start, at, g, d = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((np.arange(len(g)), d, g))
            same = (g[order][1:] == g[order][:-1]) & (d[order][1:] == d[order][:-1])
            first, twin = np.ones(len(g), bool), np.zeros(len(g), bool)
            first[order[1:]] = ~same
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            out = {c: [] for c in _SENT.names}
            f = np.flatnonzero(first)
            cuts = np.flatnonzero(np.r_[True, (doc[f][1:] != doc[f][:-1]) | (at[f][1:] != at[f][:-1]) | (start[f][1:] != start[f][:-1] + 1)])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)]):
                k = f[a]
                out["anchor"].append(g[k]), out["did"].append(ids[doc[k]]), out["th"].append(hashes[doc[k]]), out["start"].append(start[k]), out["digests"].append(d[f[a:b]].view(np.int64)), out["marks"].append(None)
            t = np.flatnonzero(twin)
            cuts = np.flatnonzero(np.r_[True, (doc[t][1:] != doc[t][:-1]) | (start[t][1:] != start[t][:-1] + 1)]) if len(t) else np.zeros(0, np.int64)
            spans: dict[int, list[int]] = {}
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)]):
                spans.setdefault(int(doc[t[a]]), []).extend((int(start[t[a]]), int(start[t[b - 1]])))
            for i, marks in spans.items():
                out["anchor"].append(hashes.view(np.uint64)[i]), out["did"].append(ids[i]), out["th"].append(hashes[i]), out["start"].append(0), out["digests"].append(None), out["marks"].append(marks)
            out["anchor"] = np.array(out["anchor"], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in _SENT], schema=_SENT)

    return docs.select("did", "th", "text").mapInArrow(run, "anchor long, did long, th long, start long, digests array<long>, marks array<long>")


def _runs(did: np.ndarray, th: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """did, th, first, last of the runs of neighbouring starts."""
    order = np.lexsort((start, th, did))
    did, th, start = did[order], th[order], start[order]
    cuts = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + 1)]) if len(did) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(did)][: len(cuts)].astype(np.int64) - 1
    return [did[cuts], th[cuts], start[cuts], start[ends]]


_EACH = ("digest", "anchor", "did", "th", "first", "last")


def _repeats(sent: DataFrame) -> DataFrame:
    """did, th, first, last: runs of starts of windows that occur twice or more.

    The windows of an anchor meet in one task, are sorted there by their digests (on disk, if need be) and pass
    through; what is marked already has its last start and passes as it is.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, did, th, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for column, marked in ((4, False), (5, True)):
                lists = batch.column(column)
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                values = lists.flatten().to_numpy(zero_copy_only=False)
                if not len(values):
                    continue
                if marked:
                    at = np.repeat(np.arange(len(n)), n // 2)
                    first, last, digest = values[::2], values[1::2], np.zeros(len(at), np.int64)
                else:
                    at = np.repeat(np.arange(len(n)), n)
                    first = start[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    last, digest = np.full(len(at), -1), values
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (digest, anchor[at], did[at], th[at], first, last)], names=list(_EACH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in parts], names=["did", "th", "first", "last"])
        before = None  # the window before this batch (digest, anchor, did, th, first) and whether it has been given
        kept, size = [], 0
        for batch in batches:
            d, g, did, th, first, last = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = last >= 0
            if done.any():
                yield pack([[x[done]] for x in (did, th, first, last)])
                d, g, did, th, first = (x[~done] for x in (d, g, did, th, first))
            if not len(d):
                continue
            same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
            twin = np.zeros(len(g), bool)
            twin[1:] |= same
            twin[:-1] |= same
            if before is not None and before[0] == d[0] and before[1] == g[0]:
                twin[0] = True
                if not before[5]:
                    kept.append([np.array([x], np.int64) for x in before[2:5]])
            before = (d[-1], g[-1], did[-1], th[-1], first[-1], bool(twin[-1]))
            kept.append([x[twin] for x in (did, th, first)])
            size += len(kept[-1][0])
            if size > GATHERED:
                yield pack([[x] for x in _runs(*(np.concatenate(x) for x in zip(*kept)))])
                kept, size = [], 0
        if kept:
            yield pack([[x] for x in _runs(*(np.concatenate(x) for x in zip(*kept)))])

    rows = sent.repartition("anchor").mapInArrow(each, ", ".join(f"{c} long" for c in _EACH))
    return rows.sortWithinPartitions("digest", "anchor").mapInArrow(run, "did long, th long, first long, last long")


def cut(words: list[bytes], marks: list[dict] | None, width: int = WIDTH) -> tuple[list[bytes], list[tuple[int, int]]]:
    """(the words that stay, the removed spans of words) where windows that start in the marked runs go."""
    spans: list[list[int]] = []
    for a, b in sorted((m["first"], m["last"] + width) for m in marks or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    at, kept = 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    return kept + words[at:], [(a, b) for a, b in spans]


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most_bits: int = SKETCH_BITS) -> DataFrame:
    """Removes every word that a window covers whose words stand somewhere else too; no occurrence is spared.

    Words are what white space of ASCII separates, compared byte for byte; windows never cross documents, and one
    that repeats within a document counts. They are judged on the input, not on what is left.

    Returns doc_id, n_words, n_removed, spans (first word and the one behind the last of each removed run), kept
    (the words that stay, one space between them). A null or empty text has no words; a text of fewer than
    `width` words loses none. Rows with a null id or one id are documents of their own; a row that is repeated is a copy
    of itself, so its windows go. Texts of any length are taken whole; other columns are not looked at. An
    empty table gives an empty result.
    """
    if not 1 <= gram <= width:
        raise ValueError("an anchor has at least one word and at most those of its window")
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = own.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(n_bytes, most_bits)
    sketch = docs.sparkSession.sparkContext.broadcast(count_min(rows, bits, width, gram))
    found = _repeats(_candidates(rows, sketch, bits, width, gram))
    marks = Stored(found.groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("marks")), "marks").df
    sketch.unpersist()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, marked, out = batch.column(0), batch.column(2).to_pylist(), []
            for i, words in _texts(batch):
                kept, spans = cut(words, marked[i], width)
                out.append((len(words), len(words) - len(kept), [{"first": a, "behind": b} for a, b in spans], b" ".join(kept)))
            n, gone, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    joined = rows.join(marks, ["did", "th"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first long, behind long>>, kept string")
