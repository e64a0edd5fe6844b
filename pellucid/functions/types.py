"""Runtime type families of properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
DECLARED = ("string", "integer", "float", "boolean", "date", "datetime")


def family(kind: T.DataType) -> str:
    """string, integer, float, boolean, date, datetime, list, map, variant or other."""
    for name, kinds in (("string", (T.StringType, T.CharType, T.VarcharType)), ("integer", INTEGRAL), ("float", FRACTIONAL), ("boolean", (T.BooleanType,)), ("date", (T.DateType,)), ("datetime", (T.TimestampType, T.TimestampNTZType)), ("list", (T.ArrayType,)), ("map", (T.MapType, T.StructType)), ("variant", (T.VariantType,))):
        if isinstance(kind, kinds):
            return name
    return "other"


def has_type(col: Column, kind: T.DataType, declared: str) -> Column:
    """Does a non-null value have the declared type? NaN is no float; lists, maps and others have none."""
    own = family(kind)
    if own == "variant":
        seen = F.schema_of_variant(col)
        tests = {
            "string": seen == "STRING", "boolean": seen == "BOOLEAN", "date": seen == "DATE", "datetime": seen.isin("TIMESTAMP", "TIMESTAMP_NTZ"), "integer": seen.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
            "float": (seen.isin("DOUBLE", "FLOAT") | seen.startswith("DECIMAL")) & ~F.isnan(F.try_variant_get(col, "$", "double")),
        }
        return F.coalesce(tests.get(declared, F.lit(False)), F.lit(False))
    if own != declared or declared not in DECLARED:
        return F.lit(False)
    return ~F.isnan(col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)


def profile_name(kind: T.DataType) -> str:
    """Type names of a profile."""
    return {"string": "STRING", "integer": "INTEGER", "float": "FLOAT", "boolean": "BOOLEAN", "list": "LIST", "map": "MAP", "date": "Date", "datetime": "DateTime"}.get(family(kind), kind.simpleString())


def variant_name(col: Column) -> Column:
    """The type name of a profile for each value of mixed types; null for a null within it."""
    seen = F.regexp_extract(F.schema_of_variant(col), r"^\w+", 0)
    names = {"STRING": "STRING", "BOOLEAN": "BOOLEAN", "BIGINT": "INTEGER", "INT": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "DOUBLE": "FLOAT", "FLOAT": "FLOAT", "DECIMAL": "FLOAT", "DATE": "Date", "TIMESTAMP": "DateTime", "TIMESTAMP_NTZ": "DateTime", "ARRAY": "LIST", "OBJECT": "MAP"}
    return F.when(seen != "VOID", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), seen), seen))
