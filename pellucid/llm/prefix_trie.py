"""Conversation prefix trie: shared prefixes of conversations, built as a Patricia tree.

A conversation is a sequence of turn digests. Equal sequences collapse to one before anything is sorted; the
distinct ones are sorted by range over the cluster, and each task goes once through its range with the stack of
open nodes. Only branches, ends and leaves become points, their edges stay compressed: counts, leaves and saved
tokens are summed on the points, and unary nodes are expanded at the very end from suffix sums over their edge.

A node that reaches over the bounds of a range is a prefix of the first or the last sequence of that range.
Every task therefore makes all prefixes of these two explicit; they are the seams, whose partial sums are joined
by digest. There are no more of them than twice the tasks times the longest sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, ship

#: Bytes of a turn's digest; rows of an Arrow batch that a task returns.
WIDTH, OUT = 16, 8_192
_POINT = "parent binary, digest binary, top long, depth long, conv_id long, parent_conv_id long, n long, children long, leaves long, below long, ends string, own long, suffix array<long>, seam boolean, paths array<long>"
_SCHEMA = pa.schema([
    ("parent", pa.binary()), ("digest", pa.binary()), ("top", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n", pa.int64()), ("children", pa.int64()),
    ("leaves", pa.int64()), ("below", pa.int64()), ("ends", pa.string()), ("own", pa.int64()), ("suffix", pa.list_(pa.int64())), ("seam", pa.bool_()), ("paths", pa.list_(pa.int64())),
])
#: The hash of no conversation at all.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: an array of (digest as 32 hex digits, words of the text) in the order of the turns.

    A turn without a number comes first, turns of one number stand in the order of their digests (repeated rows
    count as often as they come), a null role or text is empty. Rows without a conversation are left out.
    """
    own = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    item = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), F.md5(framed.cast("binary")).alias("digest"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    found = own.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation behind the first h turns of its base, the conversation of number c - c % every; it loses
    its own first h. h = crc32 of its number modulo `most`. Without a base, or where there are fewer turns, nothing is put in their place."""
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(1))))
    head = F.when(h > 0, F.slice("head", 1, F.greatest(h, F.lit(1))))
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.coalesce(head, none), F.coalesce(own, none)).alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """seq, ends: the SHA-256 of the sequence's conversations in ascending order. Sorted and streamed: no task holds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, ([], [])
        for batch in batches:
            for seq, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq != at:
                    if state is not None:
                        done[0].append(at), done[1].append(state.hexdigest())
                    at, state = seq, hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
            if len(done[0]) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=["seq", "ends"])
                done = ([], [])
        if state is not None:
            done[0].append(at), done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=["seq", "ends"])

    return rows.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(run, "seq string, ends string")


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """key (the turns' digests one behind the other), words, conv_id (the smallest), n, ends: a row for each different sequence."""
    hexes = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = convs.select("conv_id", F.md5(hexes.cast("binary")).alias("seq"), F.unhex(hexes).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    counted = rows.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("key").alias("key"), F.first("words").alias("words"))
    return counted.join(_ends(rows), "seq").select("key", "words", "conv_id", "n", "ends")


@dataclass
class _Open:
    """A point on the path to the current sequence. children, leaves and below count what hangs under it and is no seam."""

    depth: int
    seam: bool
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    below: int = 0
    ends: str | None = None
    paths: tuple[int, ...] = ()
    held: list = field(default_factory=list)


class _Range:
    """One pass over the sorted sequences of a task; gives the points of its part of the tree as they are closed."""

    def __init__(self, number: int):
        self.number, self.stack, self.rows = number, [], []
        self.key, self.words = b"", []
        self.of, self.hash, self.digests = None, None, []

    def _digest(self, depth: int) -> bytes:
        """The digest of the current sequence's first turns; those of one sequence are taken one from the other."""
        if self.of is not self.key:
            self.of, self.hash = self.key, hashlib.md5()
            self.digests = [self.hash.digest()]
        for d in range(len(self.digests), depth + 1):
            self.hash.update(self.key[(d - 1) * WIDTH : d * WIDTH])
            self.digests.append(self.hash.digest())
        return self.digests[depth]

    def _shared(self, key: bytes) -> int:
        a, b = self.key, key
        n = min(len(a), len(b)) // WIDTH
        low = 0
        while low < n and a[low * WIDTH : (low + 1) * WIDTH] == b[low * WIDTH : (low + 1) * WIDTH]:
            low += 1
        return low

    def add(self, key: bytes, words: list[int], conv: int, n: int, ends: str) -> None:
        depth = len(key) // WIDTH
        if not self.stack:  # every prefix of the first sequence is a seam
            self.stack = [_Open(d, True, paths=(2 * self.number,)) for d in range(depth + 1)]
        else:
            self._close(self._shared(key))
            if self.stack[-1].depth < depth:
                self.stack.append(_Open(depth, False))
        self.key, self.words = key, words
        top = self.stack[-1]
        top.n, top.ends, top.least = top.n + n, ends, conv if top.least is None else min(top.least, conv)

    def _close(self, depth: int) -> None:
        """Closes all points deeper than depth; where an edge passes it, a branch is made there."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Open(depth, False))
            self._hang(point, self.stack[-1])

    def _hang(self, point: _Open, under: _Open) -> None:
        under.n += point.n
        under.least = point.least if under.least is None else min(under.least, point.least)
        for row in point.held:
            row["parent_conv_id"] = point.least
        self.rows += point.held
        row = self._row(point, under.depth, self.words[under.depth : point.depth])
        if under.seam:
            row["parent"] = self._digest(under.depth)
        if point.seam:  # its sums are partial: other ranges may add to them
            self.rows.append(row)
            return
        row["leaves"] = point.leaves if point.children else 1
        row["below"] += (point.n - 1) * row["own"]  # from here on the point's own saving counts too
        under.children += 1
        under.leaves += row["leaves"]
        under.below += row["below"] + (point.n - 1) * row["suffix"][0]
        (self.rows if under.seam else under.held).append(row)

    def _row(self, point: _Open, top: int, words: list[int]) -> dict:
        """suffix: for each node of the edge the words between it and the point, without the point's own."""
        suffix = [0] * len(words)
        for i in range(len(words) - 2, -1, -1):
            suffix[i] = suffix[i + 1] + words[i]
        return {
            "parent": None, "digest": self._digest(point.depth) if point.seam else None, "top": top, "depth": point.depth, "conv_id": point.least, "parent_conv_id": None, "n": point.n, "children": point.children, "leaves": point.leaves,
            "below": point.below, "ends": point.ends, "own": words[-1] if words else 0, "suffix": suffix, "seam": point.seam, "paths": list(point.paths),
        }

    def finish(self) -> None:
        """Every prefix of the last sequence is a seam too; what its points held refers to them by digest."""
        path = 2 * self.number + 1
        for point in self.stack:
            for row in point.held:
                row["parent"] = self._digest(point.depth)
            self.rows += point.held
            point.held, point.seam = [], True
        while self.stack:
            point = self.stack.pop()
            point.paths = (*point.paths, path)
            if not point.depth:
                self.rows.append(self._row(point, 0, []))
                break
            if self.stack[-1].depth < point.depth - 1:
                self.stack.append(_Open(point.depth - 1, True))
            self._hang(point, self.stack[-1])

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _points(sorted_rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = _Range(TaskContext.get().partitionId())
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "words", "conv_id", "n", "ends")]
            for row in zip(*columns):
                part.add(*row)
                if len(part.rows) >= OUT:
                    yield part.taken()
        part.finish()
        yield part.taken()

    return sorted_rows.select("key", "words", "conv_id", "n", "ends").mapInArrow(run, _POINT)


def _seams(points: DataFrame) -> DataFrame:
    """digest, parent, conv_id, depth, n, children, leaves, saved, ends: the nodes over the bounds of ranges, with all their ranges' sums."""
    parts = points.where("seam")
    merged = Stored(parts.groupBy("digest").agg(*[F.sum(c).alias(c) for c in ("n", "children", "leaves", "below")], F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "parent", "own")], F.max("ends").alias("ends")), "seams").df
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("more"))
    nodes = merged.join(below, "digest", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long")).withColumn("saved", F.col("below") + (F.col("n") - 1) * F.col("own"))
    # a seam's sums are those of all seams under it: each belongs to one path, along which suffix sums are taken
    paths = parts.select("digest", F.explode("paths").alias("path"))
    owner = paths.groupBy("digest").agg(F.min("path").alias("owner"))
    on = paths.join(nodes.join(owner, "digest").select("digest", "owner", "depth", "leaves", "saved"), "digest")
    down = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda c: F.sum(F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0)).over(down)
    sums = on.select("digest", mine("leaves").alias("leaves"), mine("saved").alias("saved")).groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("leaves", "saved").join(sums, "digest").select("digest", "parent", "conv_id", "depth", "n", "children", "leaves", "saved", "ends")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the tree of all prefixes of conversations (conv_id, turns as sequences() gives them).

    Returns conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id, null for the root),
    n_convs, n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, the words of
    a node's last text times all members but one), ends_sha256 (of the conversations that end there, ascending).
    A conversation without turns is a member of the root alone. Without conversations there is no node.
    """
    ship(convs.sparkSession)
    own = Stored(distinct_sequences(convs), "sequences")
    points = Stored(_points(own.df.repartitionByRange("key").sortWithinPartitions("key")), "points").df
    own.drop()
    seams = Stored(_seams(points), "seams").df
    last = F.col("at") == F.size("suffix") - 1
    ends = lambda c: F.coalesce(c, F.lit(NO_ENDS)).alias("ends_sha256")
    edge = points.where("not seam").select("*", F.posexplode("suffix").alias("at", "rest"))
    nodes = edge.select(
        "conv_id", (F.col("top") + 1 + F.col("at")).alias("depth"), F.when(F.col("at") > 0, F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), F.when(F.col("at") == 0, F.col("parent")).alias("parent"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), ends(F.when(last, F.col("ends"))),
    )
    tops = seams.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "parent", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends(F.col("ends")))
    parents = seams.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    found = nodes.unionByName(tops).join(parents, "parent", "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
