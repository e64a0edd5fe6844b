"""Counts from the footers of Parquet tables: no row group is read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_sessions: dict[str, SparkSession] = {}


def _session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which Parquet answers aggregates from its statistics."""
    key = spark.sparkContext.applicationId
    if key not in _sessions:
        own = _sessions[key] = spark.newSession()
        own.conf.set("spark.sql.sources.useV1SourceList", "")
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _sessions[key]


def metadata_plan(spark: SparkSession, path: str, columns=()):
    """The aggregation of metadata_counts; its scan is pushed down to the footers, or the columns are not plain."""
    rows = _session(spark).read.parquet(path)
    return rows.agg(F.count("*").alias("*"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])


def metadata_counts(spark: SparkSession, path: str, columns=()) -> dict[str, int] | None:
    """Rows (under *) and non-null values of each column; None where the footers do not tell, as for nested columns or files without statistics."""
    kinds = _session(spark).read.parquet(path).schema
    if any(isinstance(kinds[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for c in columns):
        return None
    found = metadata_plan(spark, path, columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    if "PushedAggregation: [COUNT" not in plan:
        return None
    try:
        return found.first().asDict()
    except Exception as e:  # a file without statistics of a column
        if "statistics" not in str(e).lower():
            raise
        return None
