"""One text for each value, the same from a Spark column and from Python: equal values have equal texts.

Numbers are equal whatever their type (1, 1.0 and a decimal 1.00; whole numbers that need more than 64 bits only
if both are written exactly), booleans are apart from them, maps and structs
are equal whatever the order of their keys, lists keep theirs, instants are compared in UTC, and a map or struct
of kind (node or rel) and id stands for that element. NaN equals itself. Texts are framed by their lengths, so
no two values run into each other.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import struct
from decimal import Context, Decimal
from typing import Any
from zoneinfo import ZoneInfo

import xxhash
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers below this are written out; others of floating point are named by a hash of their 64 bits, which is one to one.
WHOLE = 10**18
#: Digits that a double keeps of any decimal.
SAFE_DIGITS = 15
ELEMENTS = ("node", "rel")
_WIDE = Context(prec=400)


def _framed(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), F.char_length(text).cast("string"), F.lit(":"), text)


def _double(x: Column) -> Column:
    whole = (F.floor(x).cast("double") == x) & (F.abs(x) < float(WHOLE))
    return F.when(F.isnan(x), F.lit("nan")).when(whole, F.concat(F.lit("i"), x.cast("long").cast("string"))).otherwise(F.concat(F.lit("f"), F.xxhash64(x).cast("string")))


def _decimal(x: Column, kind: T.DecimalType) -> Column:
    near, wide = x.cast("double"), T.DecimalType(38, kind.scale)
    exact = F.lit(True) if kind.precision <= SAFE_DIGITS else F.coalesce(near.try_cast(wide) == x.cast(wide), F.lit(False))
    plain = x.cast("string") if kind.scale == 0 else F.regexp_replace(x.cast("string"), r"\.?0+$", "")
    whole = F.lit(True) if kind.scale == 0 else F.floor(x) == x
    long = whole & (F.abs(x) < F.lit(Decimal(2**63)))
    return F.when(long, _integral(F.when(long, x).cast("long"))).when(exact & ~whole, _double(near)).otherwise(F.concat(F.lit("i"), plain))


def _integral(x: Column) -> Column:
    long = x.cast("long")
    near = long.cast("double")
    return F.when((F.abs(near) < float(WHOLE)) | (near >= 2.0**63) | (near.cast("long") != long), F.concat(F.lit("i"), long.cast("string"))).otherwise(_double(near))


def _variant(x: Column) -> Column:
    """Scalars as what they are; lists and objects by their JSON and schema."""
    seen = F.schema_of_variant(x)
    get = lambda kind: F.try_variant_get(x, "$", kind)
    json = F.to_json(x)
    return (
        F.when(seen == "VOID", F.lit("n")).when(seen == "STRING", _framed("s", get("string"))).when(seen == "BOOLEAN", F.concat(F.lit("b"), get("boolean").cast("string"))).when(seen.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), _integral(get("long")))
        .when(seen.isin("DOUBLE", "FLOAT"), _double(get("double"))).when(seen.startswith("DECIMAL"), _decimal(get("decimal(38,18)"), T.DecimalType(38, 18))).when(seen == "DATE", F.concat(F.lit("d"), get("date").cast("string")))
        .when(seen == "TIMESTAMP", F.concat(F.lit("z"), F.unix_micros(get("timestamp")).cast("string"))).otherwise(F.concat(_framed("v", seen), _framed("", json)))
    )


def canonical(x: Column, kind: T.DataType) -> Column:
    """The text of a column's values; null has one too."""
    if isinstance(kind, T.NullType):
        return F.lit("n")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out = _framed("s", x)
    elif isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("b"), x.cast("string"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = _integral(x)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _double(x.cast("double"))
    elif isinstance(kind, T.DecimalType):
        out = _decimal(x, kind)
    elif isinstance(kind, T.BinaryType):
        out = _framed("y", F.lower(F.hex(x)))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("d"), x.cast("string"))
    elif isinstance(kind, T.TimestampType):
        out = F.concat(F.lit("z"), F.unix_micros(x).cast("string"))
    elif isinstance(kind, T.TimestampNTZType):
        out = F.concat(F.lit("t"), x.cast("string"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("l"), F.size(x).cast("string"), F.lit("["), F.array_join(F.transform(x, lambda v: canonical(v, kind.elementType)), ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(x), lambda e: F.concat(_framed("k", e["key"].cast("string")), canonical(e["value"], kind.valueType)))
        out = F.concat(F.lit("m{"), F.array_join(F.array_sort(entries), ""), F.lit("}"))
        if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
            element = F.coalesce(F.element_at(x, "kind").isin(*ELEMENTS), F.lit(False)) & F.map_contains_key(x, F.lit("id"))
            out = F.when(element, F.concat(F.lit("p"), F.element_at(x, "kind"), canonical(F.element_at(x, "id"), kind.valueType))).otherwise(out)
    elif isinstance(kind, T.StructType):
        own = {f.name: canonical(x[f.name], f.dataType) for f in kind.fields}  # of columns of one name the last counts, as in a dict
        entries = [F.concat(F.lit(f"k{len(n)}:{n}"), own[n]) for n in sorted(own, key=lambda n: f"k{len(n)}:{n}".encode())]
        out = F.concat(F.lit("m{"), *entries, F.lit("}"))
        if "id" in own and isinstance(next((f.dataType for f in kind.fields if f.name == "kind"), None), T.StringType):
            out = F.when(F.coalesce(x["kind"].isin(*ELEMENTS), F.lit(False)), F.concat(F.lit("p"), x["kind"], own["id"])).otherwise(out)
    elif isinstance(kind, T.VariantType):
        out = _variant(x)
    else:
        out = _framed("u", x.cast("string"))
    return F.when(x.isNull(), F.lit("n")).otherwise(out)


def digest(x: Column, kind: T.DataType) -> Column:
    """32 bytes for each value: what travels does not grow with it."""
    return F.unhex(F.sha2(canonical(x, kind).cast("binary"), 256))


def _number(value: int | float | Decimal) -> str:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if not math.isinf(value) and value == math.floor(value) and abs(value) < WHOLE:
            return f"i{int(value)}"
        h = xxhash.xxh64_intdigest(struct.pack("<d", value), seed=42)
        return f"f{h - (1 << 64) if h >> 63 else h}"
    if isinstance(value, Decimal):
        if value.is_nan() or value.is_infinite():
            return _number(float(value))
        if value != value.to_integral_value():
            near = float(value)
            if len(value.as_tuple().digits) <= SAFE_DIGITS or Decimal(repr(near)).quantize(value, context=_WIDE) == value:
                return _number(near)
            text = format(value, "f")
            return f"i{text.rstrip('0').rstrip('.')}"
        value = int(value)
    if abs(value) < WHOLE or not -(2**63) <= value < 2**63 or int(float(value)) != value:
        return f"i{value}"
    return _number(float(value))


def canonical_of(value: Any, kind: T.DataType | None = None, zone: str = "UTC") -> str:
    """The text of a Python value. kind: the type of the column that it is held against; a time without a zone is
    taken to be of the given zone where the column holds instants."""
    if value is None:
        return "n"
    if isinstance(value, bool):
        return f"b{str(value).lower()}"
    if isinstance(value, (int, float, Decimal)):
        return _number(value)
    if isinstance(value, str):
        return f"s{len(value)}:{value}"
    if isinstance(value, (bytes, bytearray)):
        return f"y{2 * len(value)}:{bytes(value).hex()}"
    if isinstance(value, dt.datetime):
        if value.tzinfo is None and isinstance(kind, T.TimestampType):
            value = value.replace(tzinfo=ZoneInfo(zone))
        if value.tzinfo is not None:
            return f"z{(value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)}"
        return "t" + value.isoformat(sep=" ", timespec="seconds") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
    if isinstance(value, dt.date):
        return f"d{value.isoformat()}"
    if isinstance(value, Row):
        value = dict(zip(value.__fields__, value)) if hasattr(value, "__fields__") else tuple(value)
    if isinstance(value, dict):
        inner = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        own = {str(k).lower() if isinstance(k, bool) else str(k): canonical_of(v, inner.get(k, getattr(kind, "valueType", None)), zone) for k, v in value.items()}
        if value.get("kind") in ELEMENTS and "id" in value:
            return f"p{value['kind']}{own['id']}"
        return "m{" + "".join(sorted((f"k{len(k)}:{k}{v}" for k, v in own.items()), key=str.encode)) + "}"
    if isinstance(value, (set, frozenset)):
        return "e{" + "".join(sorted(canonical_of(v, None, zone) for v in value)) + "}"
    if isinstance(value, (list, tuple)):
        return f"l{len(value)}[{''.join(canonical_of(v, getattr(kind, 'elementType', None), zone) for v in value)}]"
    if hasattr(value, "toPython"):  # a variant
        return canonical_of(value.toPython(), None, zone)
    return f"u{len(str(value))}:{value}"


def digest_of(value: Any, kind: T.DataType | None = None, zone: str = "UTC") -> bytes:
    return hashlib.sha256(canonical_of(value, kind, zone).encode("utf-8", "surrogatepass")).digest()
