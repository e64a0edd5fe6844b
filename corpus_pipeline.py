"""Corpus pipeline: five stages applied to documents one after the other.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a frame; all but
the last return the columns of documents. SQL cannot express the stages, so ORACLE_SQL is None and the tests
hold run() against a plain version.

Every stage takes any columns beside doc_id and text along, texts of any length whole, and an empty table to an
empty result. What it does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.llm._common import Stored
from pellucid.llm.byte_bpe import roundtrip
from pellucid.llm.decontaminate import drop_leaks
from pellucid.llm.line_dedup import dedup_lines
from pellucid.llm.ngram_join import keep_one
from pellucid.llm.quality import keep_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the classifier learns from the labels of documents that are in docs.

    Null and empty texts are scored from their figures, and a null id counts like any other; a score of just 0.7
    stays; rows repeated with one text score alike and stay or go together. Without labels every score is one
    half, so nothing stays.
    """
    return keep_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share; n_chars follows the text.

    Rows stay, all of them: only lines go. A null text stays null, an empty one empty. The document of the
    largest id keeps a shared line, in each row that repeats it; null ids are one document smaller than all
    others. A text that loses no line keeps its n_chars, null or not.
    """
    found = dedup_lines(docs, carry=True)
    count = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long"))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept"))
    return found.select(*[{"text": text, "n_chars": count}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), that of the smallest id.

    Null ids, null texts and texts without words have no copies and stay. Rows repeated with one id are one
    document and stay or go together. A similarity of just 0.8 links.
    """
    return keep_one(docs, 5, 0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    Null and empty texts hold none and stay, null ids stay too; repeated rows stay or go together; an alignment
    of just half of an item's own score is a copy. Without items all documents stay.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every row.

    A null text counts as empty: no ids. Null ids stay null, repeated rows give repeated results.
    """
    return roundtrip(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontaminate", decontaminated), ("byte_bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents of sf_dir; the result of each is written once and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stored = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = stored.df, stored
    return docs
