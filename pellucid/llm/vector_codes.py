"""Vector code compression: product codebooks learnt over all vectors, searched by partial distances.

Vectors become integers and are cut into equal parts; each part has a codebook of its own. Codebooks are learnt
in rounds: every task assigns its vectors and sends one row of sums for each entry that it used, so what is
shuffled grows with tasks times codebook, never with vectors, and only a codebook comes to the driver. All
arithmetic is on whole numbers: results do not depend on the order of rows or on how they are split.

The nearest entry is found by partial distances: dimensions are taken in descending variance of the codebook,
the entry that leads after the first few gives a complete distance to beat, and masks drop every entry whose
accumulated distance exceeds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, ship, to_batch

#: Equal parts of a vector, entries of a codebook, rounds of learning, units in which components are counted.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components count as this at most (and its negative at least); vectors searched at once; dimensions before the first mask.
LIMIT, BLOCK, HEAD = 1 << 31, 1024, 4
#: The largest number that a column of type long holds: errors beyond it count as that.
MOST = (1 << 63) - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component, within LIMIT."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def search_order(codebook: np.ndarray) -> np.ndarray:
    """Dimensions in descending variance of the codebook, ties to the smaller."""
    c = codebook.astype(object)
    spread = len(c) * (c * c).sum(axis=0) - c.sum(axis=0) ** 2
    return np.array(sorted(range(c.shape[1]), key=lambda j: (-spread[j], j)), np.int64)


def nearest(vectors: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each vector; ties to the smaller index.

    Exact at any size: numbers whose squares could leave 64 bits are computed as Python integers.
    """
    n, dims = vectors.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, object)
    if not dims:
        return index, distance
    reach = max((int(np.abs(x).max()) for x in (vectors, codebook) if x.size), default=0)
    kind = np.int64 if (2 * reach) ** 2 * dims < 1 << 62 else object
    order = search_order(codebook)
    book = codebook[:, order].astype(kind)
    for a in range(0, n, BLOCK):
        x = vectors[a : a + BLOCK][:, order].astype(kind)
        sums = np.zeros((len(x), len(book)), kind)
        for j in range(min(HEAD, dims)):
            step = x[:, j, None] - book[None, :, j]
            sums += step * step
        leader = sums.argmin(axis=1)
        gap = x - book[leader]
        best = (gap * gap).sum(axis=1)  # the current best complete distance
        row, entry = np.nonzero(sums <= best[:, None])
        sums = sums[row, entry]
        for j in range(HEAD, dims):
            step = x[row, j] - book[entry, j]
            sums = sums + step * step
            alive = sums <= best[row]
            if not alive.all():
                row, entry, sums = row[alive], entry[alive], sums[alive]
        # pairs come by vector, then by entry; the leader itself never exceeds the bound, so each vector has one
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(sums, starts)
        hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        index[a : a + BLOCK], distance[a : a + BLOCK] = entry[first], least
    return index, distance


@dataclass(frozen=True)
class Codebooks:
    """One array of entries by components for each part; fewer than ENTRIES entries where there are fewer vectors."""

    dims: int
    parts: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return -(-self.dims // PARTS)

    def cut(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The parts of whole-number vectors; zeros fill the last one up."""
        full = np.zeros((len(vectors), self.width * PARTS), np.int64)
        full[:, : self.dims] = vectors
        return [full[:, p * self.width : (p + 1) * self.width] for p in range(PARTS)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.parts for entry in book.tolist() for x in entry).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors (in whole units) that codes of PARTS bytes stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.parts)], axis=1)[:, : self.dims]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and vector of the rows whose vector is there, has components and holds only finite ones."""
    ship(vectors.sparkSession)
    col = F.col(f"`{vector_col}`")
    kind = vectors.schema[vector_col].dataType.simpleString()
    col = col if kind == "array<float>" else col.cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), col.alias("vector"))
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # noqa: E731  a NaN is above infinity
    return rows.where((F.size("vector") > 0) & F.forall("vector", finite))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return whole(values.reshape(len(column), -1))


def _assign(rows: DataFrame, model: Codebooks) -> DataFrame:
    """part, entry, n and sums: one row for each task and each entry that it used."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in model.parts]
        total = [np.zeros(b.shape, np.int64) for b in model.parts]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(model.cut(_matrix(batch.column(0)))):
                at, _ = nearest(x, model.parts[p])
                count[p] += np.bincount(at, minlength=len(count[p]))
                order = np.argsort(at, kind="stable")
                own, starts = np.unique(at[order], return_index=True)
                total[p][own] += np.add.reduceat(x[order], starts, axis=0)
        used = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        if used:
            yield to_batch(schema, {"part": [p for p, _ in used], "entry": [e for _, e in used], "n": [int(count[p][e]) for p, e in used], "sums": [total[p][e].tolist() for p, e in used]})

    return rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def learn(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable rows; None where there are none.

    They start as the parts of the `entries` rows of the smallest ids (equal ids: of the smallest vector; a
    null id after all others). In each round every part goes to the nearest entry, and an entry becomes
    floor(sum / count) of its parts; one that got none stays. Vectors have the length of the first of those
    rows; rows of another length are no part of the model. A length that PARTS does not divide is filled up
    with zeros. Components count as within LIMIT.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["vector"])
    rows = rows.where(F.size("vector") == dims)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    model = Codebooks(dims, ())
    model = Codebooks(dims, tuple(model.cut(whole(np.array([r["vector"] for r in start], np.float64)))))
    for _ in range(rounds):
        sums = _assign(rows, model).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(model.width)])
        books = [b.copy() for b in model.parts]
        for r in sums.collect():  # a row for each entry at most
            books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(model.width)]
        model = Codebooks(dims, tuple(books))
    return model


def encode(rows: DataFrame, model: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error: the squared distances summed over the parts."""
    label = rows.schema["label"].dataType
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(x, model.parts[p]) for p, x in enumerate(model.cut(_matrix(batch.column(2))))]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = [min(MOST, int(x)) for x in sum(d for _, d in found)]
            size = 2 * PARTS
            out = to_batch(schema, {"vec_id": batch.column(0), "code": [codes[i : i + size] for i in range(0, len(codes), size)], "error": error})
            yield pa.RecordBatch.from_arrays([out.column(0), batch.column(1), out.column(1), out.column(2)], names=["vec_id", "label", "code", "error"])

    same = rows.where(F.size("vector") == model.dims).select("vec_id", "label", "vector")
    return same.mapInArrow(run, f"vec_id long, label {label.simpleString()}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error; the codebooks): every usable vector as PARTS bytes.

    Left out are vectors that are null, empty or of another length than the first, and those with a null or
    non-finite component. Repeated rows count and stand as often as they come, equal distances go to the entry of
    the smaller index. label_error is the error summed over rows of equal label, nulls together; labels are summed
    before they are joined back, so one label may hold most rows. A table without the label column has null labels;
    other columns are not looked at. Without usable rows the result is empty and the codebooks have no entry.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    model = learn(rows)
    if model is None:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).where("false")
        return empty, Codebooks(0, tuple(np.zeros((0, 0), np.int64) for _ in range(PARTS)))
    coded = Stored(encode(rows, model), "codes").df
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    # null labels are one group; numbers of labels and of rows of a label are open, so Spark picks and splits the join
    key = lambda c: F.coalesce(F.to_json(F.struct(c)), F.lit(""))
    joined = coded.withColumn("k", key(F.col("label"))).join(totals.select(key(F.col("label")).alias("k"), "label_error"), "k")
    return joined.select("vec_id", "label", "code", "error", "label_error"), model
