"""Repeated byte strings across documents, by suffix sorting with a difference cover.

Suffixes are dealt over the cluster by the smallest digest of the 24-byte strings inside their first 100
bytes, so equal 100-byte strings always meet. Neighbouring positions with the same digest travel as one unit
of text, and equal units collapse before anything is sorted. In each part of the deal the suffixes of the
units that are left are sorted by the difference cover modulo 3 (sample triples are named and sorted, the
names are sorted by recursion, the remaining suffixes are merged in), and neighbours in that order whose
first 100 bytes agree form a class, of which only the earliest occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, pick, slices, to_batch

#: Bytes of a repeat, and of the strings whose digests deal the suffixes.
LENGTH, GRAM = 100, 24
#: Letters sorted at once; distinct units from which a place of the deal is dealt again by two more digests, and how often.
SORTED_AT_ONCE, HOT_UNITS, ROUNDS = 2_000_000, 20_000, 4
#: Single starts that a task deals out at once.
SINGLES = 200_000
#: Mark of a run that may repeat itself, above any number of starts.
SELF = 1 << 31
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def suffix_ranks(text: np.ndarray, depth: int | None = None, cover: int = 3) -> np.ndarray:
    """Ranks of all suffixes of a string of positive numbers, by the difference cover modulo 3.

    With a depth, suffixes that agree on so many letters may stand in any order among themselves: recursion
    ends when names cover that many. Without one the order is complete.
    """
    n = len(text)
    t = np.concatenate([np.asarray(text, np.int64), np.zeros(3, np.int64)])
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    # sort and name the sampled triples
    names = _names(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample) and (depth is None or cover < depth):
        deeper = suffix_ranks(np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1]), depth, cover * 3)
        names = np.concatenate([deeper[: len(one)], deeper[len(one) + 1 :]])
    order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    m = np.int64(len(sample) + 2)
    # merge the remaining suffixes: a letter and the rank of the sampled suffix behind it decide
    key0 = _codes(t[zero], None) * m + rank[zero + 1]
    first = np.argsort(key0, kind="stable")
    rest = zero[first]
    in_order = sample[order]
    s1, s2 = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    before = np.searchsorted(t[s1] * m + rank[s1 + 1], t[rest] * m + rank[rest + 1])
    pairs = _codes(np.concatenate([t[s2], t[rest]]), np.concatenate([t[s2 + 1], t[rest + 1]]))
    before = before + np.searchsorted(pairs[: len(s2)] * m + rank[s2 + 2], pairs[len(s2) :] * m + rank[rest + 2])
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    out[rest] = np.arange(len(rest)) + before
    at = np.arange(len(sample))
    out[in_order] = at + np.searchsorted(before, at, side="right")
    return out


def _codes(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Numbers in the order of the letters or pairs; pairs are renumbered so that they leave room for a rank."""
    if b is None:
        return a
    high = int(max(a.max(initial=0), b.max(initial=0))) + 1
    if high * high < 1 << 31:
        return a * high + b
    return np.unique(a << 32 | b, return_inverse=True)[1].astype(np.int64)


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Names from 1 in the order of the triples."""
    high = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))) + 1
    key = (a * high + b) * high + c if high < 1 << 20 else _codes(a, b) << 32 | c
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def _gram_digests(buf: np.ndarray, salt: int) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))).view("<u8").ravel()
    h = words[:-16] + np.uint64(salt)
    for part in (words[8:-8], words[16:]):
        h = h * _A
        h ^= h >> np.uint64(29)
        h += part
        h *= _B
        h ^= h >> np.uint64(32)
    return h


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours."""
    size, out = 1, h
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - size : w - size + len(h) - w + 1]) if size < w else out


def units_of(texts_: list[bytes], salt: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, starts, key): runs of neighbouring starts of 100-byte strings with the same smallest digest.

    starts has SELF added where that digest occurs more than once in the run: the run may repeat itself.
    """
    long = [i for i, t in enumerate(texts_) if len(t) >= LENGTH]
    if not long:
        return (np.zeros(0, np.int64),) * 4
    size = np.array([len(texts_[i]) for i in long])
    ends = np.cumsum(size)
    buf = np.frombuffer(b"".join([texts_[i] for i in long]), np.uint8)
    grams, width = _gram_digests(buf, salt), LENGTH - GRAM + 1
    low = _smallest(grams, width)
    n = len(buf) - LENGTH + 1
    low = low[:n]
    own = np.repeat(np.arange(len(long)), size)[:n]
    sound = np.arange(n) + LENGTH <= ends[own]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]) | (sound[1:] != sound[:-1])])
    cuts = np.flatnonzero(new)
    stops = np.append(cuts[1:], n)
    keep = sound[cuts]
    cuts, stops = cuts[keep], stops[keep]
    doc = own[cuts]
    # places of smallest digests: a gram is the smallest of some string over it iff it equals the largest minimum there
    over = ~_smallest(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~low, np.full(width - 1, ~np.uint64(0))]), width)
    at = np.flatnonzero(grams[: len(over)] == over)
    values, number = np.unique(grams[at], return_inverse=True)
    place = np.sort(number.astype(np.int64) * (1 << 40) + at)
    mine = np.searchsorted(values, low[cuts]).astype(np.int64) * (1 << 40)
    times = np.searchsorted(place, mine + stops + width - 1) - np.searchsorted(place, mine + cuts)
    return np.array(long)[doc], cuts - (ends - size)[doc], stops - cuts + np.where(times > 1, SELF, 0), low[cuts].view(np.int64)


def _place(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | n


UNIT = pa.schema([("key", pa.int64()), ("uh", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("place", pa.int64())])
SETTLED = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("place", pa.int64())])
TEXT = pa.schema([*SETTLED, ("data", pa.binary())])
RUN = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("place", pa.int64())])
SETTLED_SQL, RUN_SQL = "key long, doc long, th long, place long", "doc long, th long, place long"


def _bytes(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in part.column(part.schema.get_field_index(name)).to_pylist()]


def _find_units(batches):
    """Units of every document (doc, th, text)."""
    for part in slices(batches):
        data = _bytes(part)
        at, start, n, key = units_of(data)
        if len(at):
            doc, th = (np.asarray(part.column(i))[at] for i in (0, 1))
            yield _collapsed(key, doc, th, start, n, [data[i] for i in at.tolist()])


def _divide(round_: int):
    """Units of hot places (doc, th, text, units) cut where the smallest digest under two more salts changes."""

    def run(batches):
        for part in slices(batches):
            keys, docs, ths, starts, ns, data = [], [], [], [], [], []
            for text, doc, th, units in zip(_bytes(part), part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()):
                for u in units:
                    start, n = u["place"] >> 32, u["place"] & SELF - 1
                    for a, b, self_, k in _again(text[start : start + n + LENGTH - 1], u["key"], 2 * round_):
                        keys.append(k), docs.append(doc), ths.append(th), starts.append(start + a), ns.append(b - a + self_), data.append(text)
            if keys:
                yield _collapsed(*(np.array(x, np.int64) for x in (keys, docs, ths, starts, ns)), data)

    return run


def _singles(batches):
    """Units of places that no deal has cooled (doc, th, text, units), start by start: the key is a digest of the 100 bytes, `uh` is another.

    Equal strings then are equal units, which are settled in a stream; what is left has no equal anywhere.
    """
    for part in slices(batches):
        keys, docs, ths, starts, data = [], [], [], [], []
        for text, doc, th, units in zip(_bytes(part), part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()):
            for u in units:
                first = u["place"] >> 32
                for start in range(first, first + (u["place"] & SELF - 1)):
                    keys.append(xxhash.xxh3_64_intdigest(text[start : start + LENGTH], 7) - (1 << 63)), docs.append(doc), ths.append(th), starts.append(start), data.append(text)
                if len(keys) > SINGLES:
                    yield _collapsed(*(np.array(x, np.int64) for x in (keys, docs, ths, starts, [1] * len(keys))), data)
                    keys, docs, ths, starts, data = [], [], [], [], []
        if keys:
            yield _collapsed(*(np.array(x, np.int64) for x in (keys, docs, ths, starts, [1] * len(keys))), data)


def _collapsed(key: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    """Rows of UNIT; of equal units in one slice only the earliest counts on, later ones have ~place for place."""
    digest = xxhash.xxh3_64_intdigest
    uh = np.array([digest(t[a : a + k + LENGTH - 1]) for t, a, k in zip(data, start.tolist(), (n & SELF - 1).tolist())], np.uint64).view(np.int64)
    place = _place(start, n)
    order = np.lexsort((place, th, doc, uh, key))
    key, uh, doc, th, place = (x[order] for x in (key, uh, doc, th, place))
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (uh[1:] == uh[:-1])])
    twin = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (place[1:] == place[:-1])])  # a row that is repeated
    place = np.where(same, ~place, place)
    keep = ~twin
    return to_batch(UNIT, {"key": key[keep], "uh": uh[keep], "doc": doc[keep], "th": th[keep], "place": place[keep]})


def _settle(batches):
    """Rows sorted by key, uh, doc, th, place. Later occurrences of a unit come out with a null key: repeats as they are.
    The earliest of each unit comes out with its key where the key has other units too; one row is held back at most."""
    last, held, several = None, None, False
    for part in batches:
        if not part.num_rows:
            continue
        key, uh, doc, th, place = (np.asarray(part.column(i)) for i in range(5))
        known = place < 0
        if known.any():
            yield to_batch(SETTLED, {"key": pa.nulls(int(known.sum()), pa.int64()), "doc": doc[known], "th": th[known], "place": ~place[known]})
            key, uh, doc, th, place = (x[~known] for x in (key, uh, doc, th, place))
            if not len(key):
                continue
        columns = (key, uh, doc, th, place)
        prev = [np.concatenate([[~x[0] if last is None else v], x[:-1]]) for v, x in zip(last or columns, columns)]
        rep = (key != prev[0]) | (uh != prev[1])
        later = ~rep & ((doc != prev[2]) | (th != prev[3]) | (place != prev[4]))
        k, d, t, p = (x[rep] for x in (key, doc, th, place))
        if held is not None:
            k, d, t, p = (np.concatenate([[v], x]) for v, x in zip(held, (k, d, t, p)))
        many = np.zeros(len(k), bool)
        if len(k):
            many[1:] |= k[1:] == k[:-1]
            many[:-1] |= k[1:] == k[:-1]
            if held is None and several:
                many |= k == last[0]
            many |= (p & SELF) > 0
            # the last one waits for another unit of its key, unless it has come out by now
            several = bool(many[-1])
            held = None if several else (k[-1], d[-1], t[-1], p[-1])
        last = tuple(x[-1] for x in columns)
        out = {"key": pa.array(np.concatenate([k[many], np.zeros(later.sum(), np.int64)]), mask=np.concatenate([np.zeros(many.sum(), bool), np.ones(later.sum(), bool)]))}
        yield to_batch(SETTLED, out | {name: np.concatenate([x[many], y[later]]) for name, x, y in (("doc", d, doc), ("th", t, th), ("place", p, place))})


def _cut_out(batches):
    """Texts of units (doc, th, text, units)."""
    for part in slices(batches):
        out: list[tuple] = []
        for text, doc, th, units in zip(_bytes(part), part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()):
            for u in units:
                start, n = u["place"] >> 32, u["place"] & SELF - 1
                out.append((u["key"], doc, th, start << 32 | n, text[start : start + n + LENGTH - 1]))
        yield to_batch(TEXT, {k: [x[i] for x in out] for i, k in enumerate(TEXT.names)})


def _again(piece: bytes, key: int, salt: int) -> list[tuple[int, int, int, int]]:
    """Parts of a unit: first start, end, SELF or 0, key."""
    parts = [units_of([piece], salt + i) for i in (0, 1)]
    edges = [*sorted({a for _, start, _n, _low in parts for a in start.tolist()}), len(piece) - LENGTH + 1]
    out = []
    for a, b in zip(edges, edges[1:]):
        at = [int(np.searchsorted(start, a, side="right")) - 1 for _, start, _n, _low in parts]
        mark = [int(low[i]) for i, (_, _start, _n, low) in zip(at, parts)]
        self_ = SELF if all(int(n[i]) & SELF for i, (_, _start, n, _low) in zip(at, parts)) else 0
        out.append((a, b, self_, xxhash.xxh3_64_intdigest(np.array([key, *mark], np.int64).tobytes()) - (1 << 63)))
    return out


def repeats(units: list[tuple[int, int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(doc, th, start, starts): runs of starts whose 100 bytes occur earlier among the units (doc, th, start, starts, text)."""
    size = np.array([len(u[4]) for u in units])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = b"\x00".join(u[4] for u in units) + bytes(8)
    letters = np.frombuffer(raw, np.uint8)[: int(size.sum()) + len(units)].astype(np.int64) + 2
    letters[begin + size] = 1  # between units; the last one ends the string
    rank = suffix_ranks(letters, LENGTH)
    doc, th, start, n = (np.array([u[i] for u in units], np.int64) for i in range(4))
    owner = np.repeat(np.arange(len(units)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + offset
    order = np.argsort(rank[at])
    at, owner, offset = at[order], owner[order], offset[order]
    # compare the prefixes of neighbours
    buf = np.frombuffer(raw, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))).view("<u8").ravel()
    same = np.ones(len(at) - 1, bool)
    for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        open_ = np.flatnonzero(same)
        same[open_] = words[at[open_] + o] == words[at[open_ + 1] + o]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    turn = np.unique(np.stack([doc, th], axis=1), axis=0, return_inverse=True)[1].astype(np.int64).ravel()
    when = turn[owner] << 32 | (start[owner] + offset)
    earliest = np.repeat(np.minimum.reduceat(when, heads), np.diff(np.append(heads, len(at))))
    gone = np.flatnonzero(when > earliest)
    if not len(gone):
        return (np.zeros(0, np.int64),) * 4
    owner, offset = owner[gone], offset[gone]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    return doc[owner[cut]], th[owner[cut]], start[owner[cut]] + offset[cut], np.diff(np.append(cut, len(owner)))


def _sort_parts(batches):
    """Units sorted by key: whole keys are gathered up to SORTED_AT_ONCE letters and sorted together."""
    held: list[tuple[int, int, int, int, bytes]] = []
    done, size, last = 0, 0, None  # units of keys that are complete

    def emit(units):
        doc, th, start, n = repeats(units)
        return to_batch(RUN, {"doc": doc, "th": th, "place": _place(start, n)})

    for part in slices(batches, "data"):
        for key, doc, th, place, data in zip(*(part.column(i).to_pylist() for i in range(5))):
            if key != last:
                done, last = len(held), key
                if size > SORTED_AT_ONCE:
                    yield emit(held)
                    held, done, size = [], 0, 0
            held.append((doc, th, place >> 32, place & SELF - 1, data))
            size += len(data)
    if held:
        yield emit(held)


def _remove(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for part in slices(batches):
        out = []
        for doc, text, runs in zip(part.column(2).to_pylist(), _bytes(part), part.column(4).to_pylist()):
            spans = []
            for place in sorted(runs or ()):
                a, b = place >> 32, min(len(text), (place >> 32) + (place & SELF - 1) + LENGTH - 1)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                elif a < b:
                    spans.append([a, b])
            ends = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])) if spans else text
            out.append((doc, len(text), kept, [{"start": a, "end": b} for a, b in spans]))
        yield to_batch(schema, {k: [x[i] for x in out] for i, k in enumerate(schema.names)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), spans (start, end of the removed runs) of every row.

    A byte goes if a 100-byte string over it also starts earlier: in a document of a smaller id, or earlier in
    the same one. Matches never cross documents; strings are judged on the input. Null or empty texts, and
    texts under 100 bytes, lose nothing. A null id comes before all others. Rows repeated with one id and text
    are one document and get the same result; rows of one id with different texts are documents of their own, in
    the order of their texts' digests. Ties do not arise: a start is earlier or later. Very long texts are read
    whole. Other columns are not looked at, whatever their names; an empty table gives an empty result.

    A place of the deal with HOT_UNITS distinct units or more is dealt again by two more digests, its equal parts
    collapse again, and so on for ROUNDS rounds. One that is hot still, as a string in very many surroundings may be, is
    dealt by its single 100-byte strings, which a stream settles by digests: no task gathers it.
    """
    rows = pick(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("th"), "doc_id", F.col("text").cast("binary").alias("text"))
    plain = rows.select("doc", "th", "text")

    def settled(units: DataFrame, name: str) -> Stored:
        dealt = units.repartition("key").sortWithinPartitions("key", "uh", "doc", "th", "place")
        out = Stored(dealt.mapInArrow(_settle, SETTLED_SQL), name)
        return out

    def with_texts(units: DataFrame) -> DataFrame:
        listed = units.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "place")).alias("units"))
        return plain.join(listed, ["doc", "th"]).select("doc", "th", "text", "units")

    unit_sql = "key long, uh long, doc long, th long, place long"
    found = settled(plain.mapInArrow(_find_units, unit_sql), "suffix-settled")
    gone, open_ = found.df.where("key is null").select("doc", "th", "place"), found.df.where("key is not null")
    for round_ in range(1, ROUNDS + 2):
        hot = Stored(open_.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_UNITS).select("key"), "suffix-hot")
        if not hot.df.limit(1).count():
            hot.drop()
            break
        last = round_ > ROUNDS
        again = settled(with_texts(open_.join(hot.df, "key", "left_semi")).mapInArrow(_singles if last else _divide(round_), unit_sql), "suffix-settled")
        gone = gone.unionByName(again.df.where("key is null").select("doc", "th", "place"))
        open_ = open_.join(hot.df, "key", "left_anti")
        if not last:
            open_ = open_.unionByName(again.df.where("key is not null"))
    pieces = with_texts(open_).mapInArrow(_cut_out, SETTLED_SQL + ", data binary")
    runs = Stored(pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_parts, RUN_SQL), "suffix-runs")
    listed = runs.df.unionByName(gone).groupBy("doc", "th").agg(F.collect_list("place").alias("runs"))
    return rows.join(listed, ["doc", "th"], "left").select("doc", "th", "doc_id", "text", "runs").mapInArrow(_remove, "doc_id long, n_bytes long, kept binary, spans array<struct<start: bigint, end: bigint>>")
