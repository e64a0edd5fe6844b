"""Benchmark decontamination: n-gram seeds, rare or many, then Smith-Waterman alignment of words.

A copy that counts has at least so many matches more than edits as its least score. Its matches lie in one run more
than it has edits at most, so that it holds (least score - 1) word pairs of the item, on diagonals that differ by
half of the item's words at most. Documents that do so are aligned however common the words are; none is missed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import pick, ship, slices, texts, to_batch

#: Words of a seed; bits of surprise from which a seed counts as rare; seeds that an item keeps if none is rare.
SEED_WORDS, RARE_BITS, LEAST_SEEDS = 3, 18.0, 3
#: Alignment: gain of a match, cost of a mismatch and of a gap; a leak scores this share of the item's own score at least.
MATCH, MISMATCH, GAP, LEAST_SHARE, LEAST_WORDS = 1, -1, -1, 0.5, 5
#: Test items are taken in blocks of at most so many bytes of text; each block is broadcast for itself.
BLOCK_BYTES = 16 << 20
#: Words that the items of a block have on average (with repeats).
BLOCK_WORDS = 1 << 20
#: Multiplier of the keys of words in a row; a key that two runs of words share costs an alignment, never a leak.
KEY = np.uint64(0x9E3779B97F4A7C15)
#: Word pairs that a document shares with items are counted in parts of about so many.
HITS_AT_ONCE = 1 << 20

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """One block of test items: their words as numbers, and the seeds by which documents find them."""

    ids: list
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    seeds: np.ndarray
    places: dict[int, list[tuple[int, int]]]
    pairs: np.ndarray
    pair_from: np.ndarray
    pair_item: np.ndarray
    pair_offset: np.ndarray
    least: np.ndarray

    def find(self, words: list[str]) -> list[tuple[int, float, int, int]]:
        """(item, share, first word, word after the last) of every leak in a document."""
        get = self.vocabulary.get
        own = np.array([get(w, -1) for w in words], np.int64)
        keys = seed_keys(own)
        if not len(keys) or not len(self.pairs):
            return []
        at = np.searchsorted(self.seeds, keys)
        hits = np.flatnonzero(self.seeds[np.minimum(at, len(self.seeds) - 1)] == keys)
        starts = self._crowded(own)
        for p in hits.tolist():
            for item, offset in self.places[int(keys[p])]:
                starts[item].append(p - offset)
        out = []
        for item, diagonals in starts.items():
            parts = [(a, b) for a, b in _windows(diagonals, len(self.words[item]), len(own)) if self._can(item, own[a:b])]
            best = max((self._align(item, own, a, b) for a, b in parts), default=None)
            if best and best[0] >= self.least[item]:
                out.append((item, best[0] / (len(self.words[item]) * MATCH), best[1], best[2]))
        return out

    def _crowded(self, own: np.ndarray) -> defaultdict:
        """Diagonals of every item of which the document holds as many word pairs, close together, as a copy must."""
        starts = defaultdict(list)
        keys = seed_keys(own, 2)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hits = np.flatnonzero(self.pairs[at] == keys)
        first, n = self.pair_from[at[hits]], np.diff(self.pair_from)[at[hits]]
        count, parts = np.zeros(len(self.ids), np.int64), np.cumsum(n) // HITS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(hits)]
        spread = lambda a, b: np.repeat(first[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(n[a:b].sum())
        for a, b in zip(cuts, cuts[1:]):
            count += np.bincount(self.pair_item[spread(a, b)], minlength=len(count))
        able = count >= self.least - 1
        if not able.any():
            return starts
        found = []
        for a, b in zip(cuts, cuts[1:]):
            where = spread(a, b)
            keep = able[self.pair_item[where]]
            found.append(np.stack([self.pair_item[where], np.repeat(hits[a:b], n[a:b]) - self.pair_offset[where]])[:, keep])
        item, diagonal = np.concatenate(found, axis=1)
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        for own_item, a, b in zip(*np.unique(item, return_index=True), [*np.flatnonzero(np.diff(item)) + 1, len(item)]):
            d, need = diagonal[a:b], int(self.least[own_item]) - 1
            near = np.flatnonzero(d[need - 1 :] - d[: len(d) - need + 1] <= len(self.words[own_item]) // 2)
            if len(near):
                mark = np.zeros(len(d) + 1, np.int64)
                np.add.at(mark, near, 1)
                np.add.at(mark, near + need, -1)
                starts[int(own_item)] += d[np.cumsum(mark[:-1]) > 0].tolist()
        return starts

    def _can(self, item: int, part: np.ndarray) -> bool:
        """Whether words in common, however ordered, could make the least score: a short text is never laid against a very long item."""
        least = int(self.least[item])
        if MATCH * min(len(part), len(self.words[item])) < least:
            return False
        words, n = np.unique(part[part >= 0], return_counts=True)
        own, m = np.unique(self.words[item], return_counts=True)
        _, i, j = np.intersect1d(words, own, assume_unique=True, return_indices=True)
        return MATCH * int(np.minimum(n[i], m[j]).sum()) >= least

    def _align(self, item: int, own: np.ndarray, a: int, b: int) -> tuple[int, int, int]:
        score, first, after = smith_waterman(self.words[item], own[a:b])
        return score, a + first, a + after


def _windows(diagonals: list[int], n: int, size: int) -> list[tuple[int, int]]:
    """Parts of a document in which an item may lie: around each start that a seed suggests, joined where they touch."""
    out: list[list[int]] = []
    for d in sorted(set(diagonals)):
        a, b = max(0, d - n // 2 - 5), min(size, d + n + n // 2 + 5)
        if out and a <= out[-1][1] and b - out[-1][0] <= 8 * n + 40:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def seed_keys(ids: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    """A number for every run of `size` words; -1 where a word is not in the vocabulary."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(size):
        part = ids[i : i + n]
        known &= part >= 0
        key = (key + part.astype(np.uint64) + np.uint64(1)) * KEY
        key ^= key >> np.uint64(29)
    return np.where(known, (key >> np.uint64(1)).astype(np.int64), -1)


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of an item's words with a window: score, first word, word after the last."""
    n, m = len(item), len(window)
    table = np.zeros((n + 1, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[1:] = np.maximum(np.maximum(table[i - 1, :-1] + np.where(window == item[i - 1], MATCH, MISMATCH), table[i - 1, 1:] + GAP), 0)
        table[i] = np.maximum.accumulate(row + slope) - slope  # gaps along the row: a running maximum
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, after = int(table[i, j]), int(j)
    while i and j and table[i, j] > 0:
        if table[i, j] == table[i - 1, j - 1] + (MATCH if window[j - 1] == item[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), after


def _counts(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How often each word of the test items occurs in all documents, and the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        total: Counter = Counter()
        known = sent.value
        for part in slices(batches):
            for text in texts(part):
                found = Counter(words_of(text))
                total[""] += found.total()
                for w in known & found.keys():
                    total[w] += found[w]
        yield to_batch(schema, {"word": list(total), "n": list(total.values())})

    rows = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def _block(docs: DataFrame, rows: list) -> Items:
    listed = [(r["item_id"], words_of(r["text"] or "")) for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    counts, total = _counts(docs, set(vocabulary))
    bits = np.zeros(len(vocabulary))
    for w, i in vocabulary.items():
        bits[i] = -np.log2((counts.get(w, 0) + 1) / (total + len(vocabulary) + 1))
    ids, arrays, places = [], [], defaultdict(list)
    for item, ws in listed:
        own = np.array([vocabulary[w] for w in ws], np.int64)
        keys = seed_keys(own)
        surprise = sum((bits[own[i : i + len(keys)]] for i in range(SEED_WORDS)), np.zeros(len(keys)))
        rare = np.flatnonzero(surprise >= RARE_BITS)
        if len(rare) < LEAST_SEEDS:
            rare = np.argsort(-surprise, kind="stable")[:LEAST_SEEDS]
        for p in rare.tolist():
            places[int(keys[p])].append((len(ids), p))
        ids.append(item)
        arrays.append(own)
    sizes = np.array([len(x) for x in arrays], np.int64)
    # alignment scores are whole numbers; items of fewer words than a seed match nothing
    least = np.maximum(np.ceil(LEAST_SHARE * sizes * MATCH), np.minimum(LEAST_WORDS, sizes * MATCH)).astype(np.int64)
    listed = [(seed_keys(x, 2), i) for i, x in enumerate(arrays) if len(x) >= SEED_WORDS]
    key = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in listed)])
    item = np.repeat([i for _, i in listed], [len(k) for k, _ in listed]).astype(np.int64)
    offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k, _ in listed)])
    order = np.argsort(key, kind="stable")
    pairs, first = np.unique(key[order], return_index=True)
    return Items(ids, vocabulary, arrays, np.array(sorted(places), np.int64), dict(places), pairs, np.append(first, len(key)), item[order], offset[order], least)


def blocks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of distinct test items, each small enough to broadcast (about BLOCK_BYTES of text and BLOCK_WORDS words)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    size, words = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")))).first())
    n = max(size // BLOCK_BYTES, words // BLOCK_WORDS) + 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield _block(docs, sorted(part, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or "")))


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and test item of which it holds an exact, edited or paraphrased copy.

    Seeds are runs of three words of an item that are rare by the frequencies of their words in all documents
    (an item without rare seeds keeps its rarest). A document that holds a seed, or as many word pairs of the item
    as any copy must hold, is aligned with the item there (Smith-Waterman over words); the pair counts if the alignment scores at least half of the item's own score.
    Columns: doc_id, item_id, share (of the item's own score), start_char, end_char (in the text).

    Null or empty texts have no leaks; items of fewer than three words have no seeds and match nothing;
    repeated rows give repeated results; null ids stay null. However often an item occurs, no pair is dropped.
    Very long texts are searched whole, around their seeds. Ties between places fall to the last of them. Other
    columns are not looked at, whatever their names; an empty table on either side gives an empty result.
    """
    rows = pick(docs, id_col, text_col)
    out = None
    for items in blocks(rows, benchmark):
        sent = rows.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES of text

        def run(batches, sent=sent):
            block = sent.value
            for part in slices(batches):
                found = []
                for doc, text in zip(part.column(0).to_pylist(), texts(part)):
                    if leaks := block.find(words_of(text)):
                        spans = _spans(text)
                        found += [(doc, block.ids[i], share, spans[a][0], spans[b - 1][1]) for i, share, a, b in leaks]
                yield to_batch(LEAKS, {k: [x[i] for x in found] for i, k in enumerate(LEAKS.names)})

        part = rows.mapInArrow(run, "doc_id long, item_id long, share double, start_char long, end_char long")
        out = part if out is None else out.unionByName(part)
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Places of the words; lower-casing may change lengths, then places are those in the lowered text."""
    return [m.span() for m in _WORD.finditer(text.lower())]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns of whatever names; nothing is shuffled.

    Null and empty texts stay; repeated rows stay or go together; very long texts are searched whole; without
    test items all documents stay; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs
    for items in blocks(pick(docs, docs.columns[0], text_col) if "doc_id" not in docs.columns else pick(docs, "doc_id", text_col), benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for part in slices(batches, text_col):
                yield part.filter(pa.array([not sent.value.find(words_of(t)) for t in texts(part, text_col)], pa.bool_()))

        rows = rows.mapInArrow(run, docs.schema)
    return rows
