"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name, byte for byte.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}

#: Spark's setting by which an execution removes its own shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local master may do without one: it gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="pellucid-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


class Stored:
    """A frame cut from its lineage: written once as Parquet to the shared folder and read back.

    An executor that is lost later takes nothing with it. drop() deletes the files as soon as no later
    step reads them; what is still there when the driver's JVM ends goes then, after the session.
    """

    def __init__(self, frame: DataFrame, name: str):
        self.spark = frame.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        where, files = self._place()
        files.deleteOnExit(where)
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")  # the shuffle files of the write go as soon as it has ended
        try:
            frame.write.option("compression", "zstd").parquet(self.path)
        finally:
            conf.set(CLEANUP, before)
        self.df = self.spark.read.schema(frame.schema).parquet(self.path)

    def _place(self):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(sc._jsc.hadoopConfiguration())

    def drop(self) -> None:
        where, files = self._place()
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives every Python worker this package, wherever the driver found it; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "pellucid_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the frame has."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def ascii_lower(col):
    """Lower-cases A-Z only; text without other letters takes the faster built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def crc_of_id(col="doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (a longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
        part = np.cumsum(np.asarray(size, dtype=np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


def local_path(name: str) -> str:
    """A vocabulary file of the public tokenizers; every machine has the package installed."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)
