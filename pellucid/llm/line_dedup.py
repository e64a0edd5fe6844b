"""Line dedup over a corpus, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import SPACES, ascii_lower


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashed(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows with `lines` and `hashes`: a 128-bit digest of each line's key, null where the key is too short."""
    rows = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    keys = F.transform("lines", lambda x: F.when(F.octet_length(x) >= min_chars, line_key(x)))  # fewer bytes are fewer characters
    return rows.withColumn("hashes", F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k.cast("binary"))))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: bool = False) -> DataFrame:
    """Drops lines that at least `min_docs` documents share, except in the document with the largest id.

    Lines are exploded with their positions, their normalised keys hashed, distinct documents counted for
    each hash, lines over the threshold dropped and the rest put together again by position. A hash that a
    third of the rows holds is counted before the shuffle and joined through Spark's skew join; only digests,
    ids and positions are dealt by key, texts only by document.

    Returns doc_id, text (what was given), kept (what stays), n_lines, n_dropped; with carry, also `row`: the
    other columns of the input as a struct. Null or empty text: one
    empty line, kept is the empty string. A null id counts as one document smaller than all others. Rows
    repeated with the same id and text get the same result each; they count as one document. Other columns
    of the input are not looked at. An empty table gives an empty result.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if carry else []
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([F.struct(*rest).alias("row")] if carry else []))
    rows = own.withColumn("did", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("th", F.xxhash64("text"))
    lines = (
        _hashed(rows, min_chars).select("did", "th", F.posexplode("hashes").alias("pos", "h")).where(F.col("h").isNotNull())
    )
    shared = (
        lines.groupBy("h").agg(F.count_distinct("did").alias("n_docs"), F.max("did").alias("keeper")).where(F.col("n_docs") >= min_docs).select("h", "keeper")
    )
    lost = lines.join(shared, "h").where("did <> keeper").groupBy("did", "th").agg(F.collect_set("pos").alias("lost"))
    found = rows.join(lost, ["did", "th"], "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return found.select(
        "doc_id", "text", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), *(["row"] if carry else []), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped")
    )
