"""N-gram Jaccard join with a token-group matrix.

All documents agree on one order of the shingles, from rare to common. Two linked sets share a shingle among
the first few of each (all but the size that they must have in common, and one), so only those few are dealt
over the cluster, and what is common to many documents brings hardly any of them together. Documents that
meet at enough shingles are first held against one of them, which links most copies. The rest are partitioned into
groups of similar documents (by their most crowded meeting place, linked class and size); each group's token
union is stored; a document that meets members of a group is bounded against that union, and only groups that
the bound lets through are opened. Every link between different classes is found; inside a class none is
needed.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, pick, slices, texts, to_batch
from pellucid.llm.components import components

#: Buckets of the counts that order the shingles: fixed, so that the table (one number each) may be broadcast at any size.
BUCKETS = 1 << 18
#: Counts in a row on their way to the sum.
STRETCH = 4096
#: Shingles of a group's members together, and documents that ask a group in one task.
GROUP_TOKENS, ASKING = 1 << 16, 2048
#: Members from which a linked class has groups of its own.
CLASS = 64
#: Bits of the table by which a scan passes over documents that nothing asks for: fixed as well.
BITS = 1 << 23
#: Sets that a task remembers so as to deal equal ones once.
REMEMBERED = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit digests of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, n: int):
        self.n, self.words = n, _Words()

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct digests of a text's word n-grams; fewer words make one shingle, no word none."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array(list(map(self.words.__getitem__, words)), np.uint64)
        n = min(self.n, len(words))
        size = len(words) - n + 1
        out = np.full(size, n, np.uint64)
        for i in range(n):
            out = _mix(out * _A + h[i : i + size])
        return np.unique(out)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("stretch", pa.int32()), ("counts", pa.binary())])
SET_SQL = "doc_id long, n long, f1 long, f2 long, stretch int, counts binary"
PLACE = pa.schema([("tok", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])
MET = pa.schema([("list", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("ln", pa.int64())])
MET_SQL = "list long, f1 long, f2 long, n long, l1 long, l2 long, ln long"
TOKENS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("set", pa.list_(pa.int64()))])


class _Remembered(set):
    """Prints seen by a task; forgets all when it is full, which only costs repetition."""

    def new(self, print_: tuple[int, int]) -> bool:
        if print_ in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(print_)
        return True


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """Size and 128-bit print of each row's set; and from each task its counts of shingles by bucket, in stretches."""

    def run(batches):
        shingler, seen, counts = Shingler(n), _Remembered(), np.zeros(BUCKETS, np.uint32)
        for part in slices(batches):
            found = [shingler(t) for t in texts(part)]
            prints = [_digest(s) for s in found]
            fresh = [s for s, f in zip(found, prints) if len(s) and seen.new(f)]
            if fresh:
                counts += np.bincount(_bucket(np.concatenate(fresh)), minlength=BUCKETS).astype(np.uint32)
            none = pa.nulls(part.num_rows)
            yield to_batch(SET, {"doc_id": part.column(0), "n": [len(s) for s in found], "f1": [a for a, _ in prints], "f2": [b for _, b in prints], "stretch": none.cast(pa.int32()), "counts": none.cast(pa.binary())})
        at = [k for k in range(0, BUCKETS, STRETCH) if counts[k : k + STRETCH].any()]
        none = pa.nulls(len(at), pa.int64())
        yield to_batch(SET, {"doc_id": none, "n": none, "f1": none, "f2": none, "stretch": at, "counts": [counts[k : k + STRETCH].tobytes() for k in at]})

    return rows.mapInArrow(run, SET_SQL)


def _crowds(table: DataFrame) -> np.ndarray:
    """The counts of all tasks together; BUCKETS numbers come to the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["stretch", "counts"])

    out = np.zeros(BUCKETS, np.uint64)
    for r in table.where("stretch is not null").select("stretch", "counts").repartition("stretch").mapInArrow(run, "stretch int, counts binary").collect():
        out[r["stretch"] : r["stretch"] + STRETCH] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def first_places(tokens: np.ndarray, crowds: np.ndarray, share: Fraction) -> np.ndarray:
    """The rarest shingles of a set, as many as it has above what a linked set must share with it, and one.

    Ties fall to the smaller shingle, so all sets agree on the order, and two linked sets have their rarest
    common shingle among the first places of both.
    """
    n = len(tokens)
    must = -(-n * share.numerator // share.denominator)
    return tokens[np.argsort(crowds[_bucket(tokens)], kind="stable")[: n - must + 1]]


def _places(rows: DataFrame, n: int, share: Fraction, crowds: np.ndarray) -> DataFrame:
    """tok, n, f1, f2: the first places of each set, once for the equal sets of a task."""
    sent = rows.sparkSession.sparkContext.broadcast(crowds)  # BUCKETS numbers of 4 bytes

    def run(batches):
        shingler, seen = Shingler(n), _Remembered()
        for part in slices(batches):
            toks, sizes, prints = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), texts(part)):
                s = shingler(text)
                if doc is None or not len(s) or not seen.new(f := _digest(s)):
                    continue
                toks.append(first_places(s, sent.value, share))
                sizes.append(len(s)), prints.append(f)
            if toks:
                many = [len(t) for t in toks]
                f = np.repeat(np.array(prints, np.int64), many, axis=0)
                yield to_batch(PLACE, {"tok": np.concatenate(toks).view(np.int64), "n": np.repeat(np.array(sizes, np.int64), many), "f1": f[:, 0], "f2": f[:, 1]})

    return rows.mapInArrow(run, "tok long, n long, f1 long, f2 long")


def _meet(low: int, high: int):
    """Rows sorted by tok, n, f1, f2: those that share a tok with another set, with the first one as leader.

    Equal sets count once. A list ends where the next size is out of reach of the last. One row is held back.
    """

    def run(batches):
        held = lead = None  # the last row, and (begins, list, l1, l2, ln) of it
        for part in batches:
            if not part.num_rows:
                continue
            tok, n, f1, f2 = (np.asarray(part.column(i)) if held is None else np.concatenate([held[i], np.asarray(part.column(i))]) for i in range(4))
            same = (tok[1:] == tok[:-1]) & (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1]) & (n[1:] == n[:-1])
            tok, n, f1, f2 = (x[np.concatenate([[True], ~same])] for x in (tok, n, f1, f2))
            begins = np.concatenate([[held is None or lead[0]], (tok[1:] != tok[:-1]) | (n[:-1] * high < n[1:] * low)])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(tok)), 0))
            name = _mix(tok.view(np.uint64) + n.astype(np.uint64) * _A).view(np.int64)
            led = [x[at] for x in (name, f1, f2, n)]
            if not begins[0]:
                for x, v in zip(led, lead[1:]):
                    x[at == 0] = v
            keep = ~(begins[:-1] & begins[1:])
            yield to_batch(MET, dict(zip(MET.names, (x[:-1][keep] for x in (led[0], f1, f2, n, *led[1:])))))
            held, lead = [x[-1:] for x in (tok, n, f1, f2)], (bool(begins[-1]), *(x[-1] for x in led))
        if held is not None and not lead[0]:
            yield to_batch(MET, dict(zip(MET.names, ([lead[1]], held[2], held[3], held[1], *([x] for x in lead[2:])))))

    return run


def _node():
    return F.struct("f1", "f2")


def _bits(ids: DataFrame) -> np.ndarray:
    """A table of BITS bits, set for the digests of the ids; its bytes (a megabyte) come to the driver."""

    def run(batches):
        table = np.zeros(BITS, bool)
        for part in batches:
            table[_places_of(np.asarray(part.column(0)))] = True
        packed = np.packbits(table)
        at = [k for k in range(0, len(packed), 4 * STRETCH) if packed[k : k + 4 * STRETCH].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[k : k + 4 * STRETCH].tobytes() for k in at], pa.binary())], ["stretch", "bits"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                total[k] = total.get(k, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["stretch", "bits"])

    out = np.zeros(BITS // 8, np.uint8)
    schema = "stretch int, bits binary"
    for r in ids.mapInArrow(run, schema).repartition("stretch").mapInArrow(merge, schema).collect():
        out[r["stretch"] : r["stretch"] + 4 * STRETCH] = np.frombuffer(r["bits"], np.uint8)
    return out


def _places_of(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64) * _A) >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _tokens(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node and set of the nodes asked for (node, first: a document that has the set), and of a few more.

    The texts are scanned where they lie and only documents whose bit is set are shingled, so no text is
    shuffled; equal sets come once from a task. Rows that nothing asked for fall out of the joins that follow.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_bits(nodes.select("first")))  # BITS bits

    def run(batches):
        shingler, seen = Shingler(n), _Remembered()
        for part in slices(batches):
            ids = part.column(0)
            at = _places_of(np.asarray(ids.fill_null(0)))
            asked = part.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & np.asarray(ids.is_valid())))
            found = [s for s in map(shingler, texts(asked)) if len(s)]
            fresh = [(f, s) for s in found if seen.new(f := _digest(s))]
            yield to_batch(TOKENS, {"f1": [f[0] for f, _ in fresh], "f2": [f[1] for f, _ in fresh], "set": [s.view(np.int64) for _, s in fresh]})

    return rows.mapInArrow(run, "f1 long, f2 long, set array<bigint>").select(_node().alias("node"), "set")


def _spare(n, other, share: Fraction):
    """What two linked sets of these sizes must have in common among their first places, less one: they share
    share / (1 + share) of their sizes' sum, and behind the first places of the larger one lie share of its size at most."""
    return F.lit(float(share / (1 + share))) * (n + other) - F.lit(float(share)) * F.greatest(n, other) - F.lit(1e-6)


def _likely(met: DataFrame, share: Fraction) -> DataFrame:
    """Pairs (a, b) of a set and a leader that it meets in half of the places in which linked sets meet, or more.

    They only make the classes; links that are not among them are found between the groups.
    """
    low, high = share.numerator, share.denominator
    pairs = met.where((F.col("node") != F.col("leader")) & (F.col("ln") * high >= F.col("n") * low)).groupBy("node", "leader").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("ln").alias("ln"))
    return pairs.where(2 * F.col("times") > _spare(F.col("n"), F.col("ln"), share)).select(F.col("node").alias("a"), F.col("leader").alias("b"))


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """list, docs, node, n, own (linked class), members (of that class) at the places where different classes meet."""
    many = labels.groupBy("component").agg(F.count("*").alias("members"))
    classes = labels.join(many, "component").select(F.col("id").alias("node"), "component", "members")
    placed = met.join(classes, "node", "left").select("list", "node", "n", F.coalesce("component", "node").alias("own"), F.coalesce("members", F.lit(1)).alias("members"))
    ends = [f(f"own.{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("f1", "f2")]
    lists = placed.groupBy("list").agg(F.count("*").alias("docs"), *ends).where("min_f1 <> max_f1 or min_f2 <> max_f2").select("list", "docs")
    return placed.join(lists, "list")


def _grouped(mixed: DataFrame, share: Fraction) -> DataFrame:
    """node, n, own, members, block of every document at a mixed place: each document is in one group.

    Similar documents have the most crowded place in common; large linked classes stand apart, and a group's
    sizes lie within what can link. Groups of more than GROUP_TOKENS shingles are cut by hash.
    """
    home = mixed.groupBy("node").agg(F.max(F.struct("docs", "list")).alias("top"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("members").alias("members"))
    level = F.floor(F.log(F.col("n")) / -math.log(share) + 1e-9)
    keyed = home.withColumn("key", F.xxhash64("top.list", F.when(F.col("members") >= CLASS, F.col("own")), level))
    parts = keyed.groupBy("key").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("parts"))
    return keyed.join(parts, "key").select("node", "n", "own", "members", F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def _asked(mixed: DataFrame, grouped: DataFrame, share: Fraction) -> DataFrame:
    """node, own, n, block: the groups that a document meets in as many places as it would meet a linked member.

    Of two classes the smaller one asks (ties: the one of the smaller print), so that a large linked class never does.
    """
    low, high = share.numerator, share.denominator
    at = mixed.select("list", "node").join(grouped, "node").withColumn("rank", F.struct("members", "own"))
    groups = at.groupBy("list", F.col("block").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rank").alias("top"))
    meets = at.join(groups, "list").where((F.col("rank") < F.col("top")) & (F.col("most") * high >= F.col("n") * low) & (F.col("least") * low <= F.col("n") * high))
    found = meets.groupBy("node", "own", "n", F.col("other").alias("block")).agg(F.count("*").alias("times"), F.min("least").alias("least"), F.max("most").alias("most"))
    n = F.col("n")  # the fewest places are shared at one of the two ends of the sizes that a linked member may have
    ends = F.greatest("least", n * float(share)), F.least("most", n / float(share))
    return found.where(F.col("times") > F.least(*[_spare(n, e, share) for e in ends])).select("node", "own", "n", "block")


class Group:
    """Documents of a group: the union of their tokens, and the documents by token."""

    def __init__(self, owns: list, sets: list[np.ndarray]):
        self.owns, self.size = owns, np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.union = np.unique(self.tokens)

    def may_hold(self, tokens: np.ndarray, low: int, high: int) -> bool:
        """Whether the union has enough of a set's tokens for any member to be linked with it."""
        near = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        return int(np.count_nonzero(self.union[near] == tokens)) * high >= len(tokens) * low

    def linked(self, tokens: np.ndarray, low: int, high: int) -> set:
        """Classes of the members that a set is linked with: all members are counted at once."""
        first, stop = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, side="right")
        n = stop - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))
        return {self.owns[k] for k in np.flatnonzero(common * high >= (len(tokens) + self.size - common) * low)}


class _Joined(dict):
    """Classes that links of this task have joined so far, as parents."""

    def root(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, a, b) -> bool:
        """False if the two were joined already."""
        a, b = self.root(a), self.root(b)
        self[a] = b
        return a != b


PAIR = pa.struct([("f1", pa.int64()), ("f2", pa.int64())])


def _open(low: int, high: int):
    """Rows sorted by block, q and asks, so that a group's members come before the documents that ask it.

    A document is bounded against the group's union; only if that lets it through is the group opened for it.
    Of the links that are found those leave the task that join classes which no earlier link of it has joined.
    """
    schema = pa.schema([("a", PAIR), ("b", PAIR)])

    def named(found):
        return pa.array([{"f1": a, "f2": b} for a, b in found], PAIR)

    def run(batches):
        key, group, owns, sets, joined = None, None, [], [], _Joined()
        for part in batches:
            own = list(zip(part.column(3).field(0).to_pylist(), part.column(3).field(1).to_pylist()))
            tokens, at = part.column(4).values.to_numpy(), part.column(4).offsets.to_numpy()
            found = []
            for i, (block, q, asks) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)))):
                if (block, q) != key:
                    key, group, owns, sets, joined = (block, q), None, [], [], _Joined()
                mine = tokens[at[i] : at[i + 1]]
                if not asks:
                    owns.append(own[i]), sets.append(mine)
                elif sets:
                    group = group or Group(owns, sets)
                    if group.may_hold(mine, low, high):
                        found += [(own[i], x) for x in sorted(group.linked(mine, low, high) - {own[i]}) if joined.join(own[i], x)]
            if found:
                yield to_batch(schema, {"a": named([a for a, _ in found]), "b": named([b for _, b in found])})

    return run


def _linked(asked: DataFrame, held: DataFrame, first: DataFrame, rows: DataFrame, n: int, share: Fraction, name: str) -> Stored:
    """Links (a, b) between classes: asked (node, own, block) are held against the members held (node, own, block) of their group.

    Sets are made where the texts lie and sent to the groups once: a group that many documents ask is sent to
    several tasks, a document to each group that it asks.
    """
    many = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKING).alias("parts"))
    asking = asked.join(many, "block").select("node", "own", "block", F.pmod(F.xxhash64("node", "block"), "parts").alias("q"), F.lit(True).alias("asks"))
    each = held.join(many, "block").select("node", "own", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"), F.lit(False).alias("asks"))
    routes = Stored(asking.unionByName(each), "ngram-routes")
    sets = _tokens(rows, routes.df.select("node").distinct().join(first, "node"), n)
    dealt = sets.join(routes.df, "node").select("block", "q", "asks", "own", "set").repartition("block", "q").sortWithinPartitions("block", "q", "asks")
    links = Stored(dealt.mapInArrow(_open(share.numerator, share.denominator), "a struct<f1:bigint,f2:bigint>, b struct<f1:bigint,f2:bigint>"), name)
    routes.drop()
    return links


def _across(met: Stored, labels: DataFrame, first: DataFrame, rows: DataFrame, n: int, share: Fraction) -> Stored | None:
    """Links between classes whose documents meet, by the groups' token unions; None where none can be."""
    mixed = Stored(_mixed(met.df.select("list", "node", "n"), labels), "ngram-mixed")
    met.drop()
    if not mixed.df.limit(1).count():
        mixed.drop()
        return None
    grouped = Stored(_grouped(mixed.df, share), "ngram-groups")
    asked = Stored(_asked(mixed.df, grouped.df, share), "ngram-asked")
    mixed.drop()
    held = grouped.df.join(asked.df.select("block").distinct(), "block", "left_semi").select("node", "own", "block")
    links = _linked(asked.df.select("node", "own", "block"), held, first, rows, n, share, "ngram-more")
    grouped.drop()
    asked.drop()
    return links


def ngram_components(docs: DataFrame, n: int = 5, share: Fraction | float = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row.

    A document's set: distinct word n-grams after lower-casing A-Z and splitting at ASCII white space; a
    text of fewer words is one shingle; null or empty texts have none and link with nothing (their component
    is their own id). Two documents link when intersection / union >= share. Links are verified exactly on
    64-bit digests of the shingles; sets are told apart by 128-bit prints.

    Each row is judged by its own text: rows with the same id and text get equal results, rows with one id and
    different texts link separately. A null id links with nothing and has a null component. Very long texts
    are shingled whole; one set is held in memory at a time, and a group holds one long set or GROUP_TOKENS
    shingles. Ties in the order of shingles and of classes are broken by digests. Other columns of the input
    are not looked at, whatever their names. An empty table gives an empty result.
    """
    share = share if isinstance(share, Fraction) else Fraction(str(share))
    low, high = share.numerator, share.denominator
    rows = pick(docs, id_col, text_col)
    table = Stored(_sets(rows, n), "ngram-sets")
    every = table.df.where("stretch is null").select("doc_id", "n", "f1", "f2")
    places = _places(rows, n, share, _crowds(table.df)).repartition("tok").sortWithinPartitions("tok", "n", "f1", "f2")
    met = Stored(places.mapInArrow(_meet(low, high), MET_SQL).select("list", _node().alias("node"), "n", F.struct(F.col("l1").alias("f1"), F.col("l2").alias("f2")).alias("leader"), "ln"), "ngram-met")
    first = every.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).select(_node().alias("node"), "first", "copies")
    first = Stored(first, "ngram-first").df
    likely = Stored(_likely(met.df, share), "ngram-likely")
    # a leader is a group of its own at first, and every set a class
    block = F.xxhash64("b").alias("block")
    held = likely.df.select(F.col("b").alias("node"), F.col("b").alias("own"), block).distinct()
    led = _linked(likely.df.select(F.col("a").alias("node"), F.col("a").alias("own"), block), held, first, rows, n, share, "ngram-links")
    likely.drop()
    labels = components(led.df)
    led.drop()
    more = _across(met, labels.df, first, rows, n, share)
    linked = first.join(labels.df.select(F.col("id").alias("node"), "component"), "node", "left")
    if more is not None and more.df.limit(1).count():  # these links join classes
        joined = components(more.df)
        linked = linked.withColumn("class", F.coalesce("component", "node")).join(joined.df.select(F.col("id").alias("class"), F.col("component").alias("joined")), "class", "left")
        linked = linked.select("node", "first", "copies", F.coalesce("joined", "component").alias("component"))
    least = linked.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = linked.where("component is not null or copies > 1").join(least, "component", "left").select("node", F.coalesce("least", "first").alias("least"))
    keyed = every.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), _node()))
    return keyed.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, share: Fraction | float = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, that of the smallest id, with all their columns.

    Rows with a null id, a null or an empty text stay. Rows repeated with one id are one document and stay or go
    together: they stay if any of them leads its component. Columns of any name are carried along; an empty
    table gives an empty result.
    """
    found = ngram_components(docs, n, share, id_col, text_col).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("leads"))
    name = "copy"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.join(found.where("not leads").select(F.col("doc_id").alias(name)), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
