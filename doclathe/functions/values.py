"""Columns with their types, literals, and comparisons by value class.

Spark's types are static, so what depends on a value's type in a document language is decided when a spec
is compiled: a comparison of values of different classes is the constant false, not a cast."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError

NULL = T.NullType()


@dataclass(frozen=True)
class Val:
    """A Column and its type.  A missing field is the typed null of NullType."""

    col: Column
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)


def missing() -> Val:
    return Val(F.lit(None), NULL)


def kind_of(dtype: T.DataType) -> str:
    """null, number, string, bool, date, binary, array, object or variant."""
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.VariantType):
        return "variant"
    return "other"


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both; raises SpecError if there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    ka, kb = kind_of(a), kind_of(b)
    if ka == kb == "number":
        if is_integral(a) and is_integral(b):
            return T.LongType()
        return T.DoubleType()
    if ka == kb == "date":
        return T.TimestampNTZType() if isinstance(a, T.TimestampNTZType) or isinstance(b, T.TimestampNTZType) else T.TimestampType()
    if ka == kb == "string":
        return T.StringType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        return T.StructType([T.StructField(n, common_type(a[n].dataType if n in a.names else NULL, b[n].dataType if n in b.names else NULL)) for n in names])
    raise SpecError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def shared_type(types) -> T.DataType:
    """A type that holds all; text where there is none better."""
    out: T.DataType = NULL
    for t in types:
        try:
            out = common_type(out, t)
        except SpecError:
            return T.StringType()
    return out


def coerce(v: Val, to: T.DataType) -> Column:
    """The value as type ``to``, which must come from common_type."""
    if v.dtype == to:
        return v.col
    if isinstance(v.dtype, T.NullType):
        return F.lit(None).cast(to)
    if isinstance(v.dtype, T.ArrayType) and isinstance(to, T.ArrayType):
        inner = v.dtype.elementType
        return F.transform(v.col, lambda x: coerce(Val(x, inner), to.elementType))
    if isinstance(v.dtype, T.StructType) and isinstance(to, T.StructType):
        parts = [coerce(field(v, n), to[n].dataType).alias(n) for n in to.names]
        return F.when(v.col.isNotNull(), F.struct(*parts)).otherwise(F.lit(None).cast(to))
    if isinstance(to, T.StringType):
        return text_of(v)
    return v.col.cast(to)


def field(v: Val, name: str) -> Val:
    """A field of an object, or missing."""
    if isinstance(v.dtype, T.StructType):
        return Val(v.col.getField(name), v.dtype[name].dataType) if name in v.dtype.names else missing()
    if isinstance(v.dtype, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.dtype.valueType)
    if isinstance(v.dtype, T.ArrayType) and name.isdigit():
        return Val(F.get(v.col, F.lit(int(name))), v.dtype.elementType)
    return missing()


def literal(x, hint: T.DataType | None = None) -> Val:
    """A Python value as a Column."""
    if isinstance(x, Val):
        return x
    if x is None:
        return missing()
    if isinstance(x, bool):
        return Val(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        if not -(1 << 63) <= x < 1 << 63:
            return Val(F.lit(float(x)), T.DoubleType())
        return Val(F.lit(x).cast("long"), T.LongType()) if hint is None or not is_integral(hint) else Val(F.lit(x), T.LongType())
    if isinstance(x, (float, decimal.Decimal)):
        return Val(F.lit(float(x)), T.DoubleType())
    if isinstance(x, (bytes, bytearray)):
        return Val(F.lit(bytearray(x)), T.BinaryType())
    if isinstance(x, datetime.datetime):
        if x.tzinfo is None:
            return Val(F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz"), T.TimestampNTZType())
        return Val(F.lit(x).cast("timestamp"), T.TimestampType())
    if isinstance(x, datetime.date):
        return Val(F.lit(x), T.DateType())
    if isinstance(x, (list, tuple)):
        items = [literal(i) for i in x]
        of: T.DataType = NULL
        for i in items:
            of = common_type(of, i.dtype)
        if not items:
            return Val(F.array(), T.ArrayType(NULL))
        return Val(F.array(*(coerce(i, of) for i in items)), T.ArrayType(of))
    if isinstance(x, dict):
        return struct({k: literal(v) for k, v in x.items()})
    return Val(F.lit(str(x)), T.StringType())


def struct(fields: dict[str, Val]) -> Val:
    """A new object; without fields it is the null object."""
    if not fields:
        return Val(F.lit(None).cast(T.StructType([])), T.StructType([]))
    return Val(F.struct(*(v.col.alias(k) for k, v in fields.items())), T.StructType([T.StructField(k, v.dtype) for k, v in fields.items()]))


def sure(c: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(c, F.lit(False))


def comparable(a: Val, b: Val) -> bool:
    return a.kind == b.kind and a.kind not in ("null", "other", "variant")


def _same_dates(a: Val, b: Val) -> tuple[Column, Column]:
    if a.kind == "date" and a.dtype != b.dtype:
        to = common_type(a.dtype, b.dtype)
        return (a.col.cast(to) if a.dtype != to else a.col), (b.col.cast(to) if b.dtype != to else b.col)
    return a.col, b.col


def equal(a: Val, b: Val) -> Column:
    """Deep equality in which null equals null only; never null itself."""
    if a.kind == "null" or b.kind == "null":
        return F.lit(True) if a.kind == b.kind else (b if a.kind == "null" else a).col.isNull()
    if a.kind == b.kind == "array":
        if isinstance(a.dtype.elementType, T.NullType) or isinstance(b.dtype.elementType, T.NullType):
            return sure(F.size(a.col) == F.size(b.col)) & sure(F.forall(a.col, lambda x: x.isNull())) & sure(F.forall(b.col, lambda x: x.isNull())) | (a.col.isNull() & b.col.isNull())
        try:
            to = common_type(a.dtype, b.dtype)
        except SpecError:
            return a.col.isNull() & b.col.isNull()
        return coerce(a, to).eqNullSafe(coerce(b, to))
    if isinstance(a.dtype, T.StructType) and isinstance(b.dtype, T.StructType):
        same = a.col.isNotNull() & b.col.isNotNull()
        for n in dict.fromkeys([*a.dtype.names, *b.dtype.names]):
            same = same & equal(field(a, n), field(b, n))
        return same | (a.col.isNull() & b.col.isNull())
    if not comparable(a, b):
        return a.col.isNull() & b.col.isNull()
    x, y = _same_dates(a, b)
    return x.eqNullSafe(y)


def matches(a: Val, b: Val) -> Column:
    """Equality for filters, null if either side is; the plain form, which reaches the scan."""
    if comparable(a, b) and a.kind not in ("array", "object"):
        x, y = _same_dates(a, b)
        return x == y
    return equal(a, b)


def compare(op: str, a: Val, b: Val) -> Column:
    """>, >=, <, <=; false for values of different classes and for NaN; null if either side is null."""
    if not comparable(a, b) or a.kind in ("object", "array"):
        return F.lit(False)
    x, y = _same_dates(a, b)
    out = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    # Spark holds NaN above all numbers.
    if op in (">", ">=") and is_float(a.dtype):
        out = out & ~F.isnan(x)
    if op in ("<", "<=") and is_float(b.dtype):
        out = out & ~F.isnan(y)
    return out


# The order of classes of values that a field of any type is sorted by.
CLASSES = (("^VOID$", 0), ("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$", 1), ("^STRING$", 2), ("^OBJECT<", 3), ("^BOOLEAN$", 4), ("^(DATE|TIMESTAMP)", 5), ("^ARRAY<", 6))


def variant_class(c: Column) -> Column:
    """The class of a VARIANT's value as a number; 0 for null."""
    name = F.schema_of_variant(c)
    out = F.when(c.isNull(), 0)
    for form, n in CLASSES:
        out = out.when(name.rlike(form), n)
    return out.otherwise(7)


def variant_number(c: Column) -> Column:
    """A VARIANT's number, null if it isn't one."""
    return F.when(variant_class(c) == 1, F.try_variant_get(c, "$", "double"))


def variant_key(c: Column) -> Column:
    """What VARIANTs sort by: class, then number, truth or time, then text.  Objects and arrays are equal among
    themselves."""
    of = variant_class(c)
    number = F.when(of == 1, F.try_variant_get(c, "$", "double")).when(of == 4, F.try_variant_get(c, "$", "boolean").cast("double"))
    number = number.when(of == 5, F.unix_micros(F.try_variant_get(c, "$", "timestamp")).cast("double"))
    return F.struct(of.alias("class"), number.alias("number"), F.when(of == 2, F.try_variant_get(c, "$", "string")).alias("text"))


def variant_text(c: Column) -> Column:
    """JSON text that is the same for equal values; null for null."""
    of = variant_class(c)
    return F.when(of == 1, text_of(Val(F.try_variant_get(c, "$", "double"), T.DoubleType()))).when(of != 0, F.to_json(c))


def truthy(v: Val) -> Column:
    """False, null and 0 are false; all else is true, NaN and the empty string too."""
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return sure(v.col)
    if v.kind == "number":
        return sure(v.col != 0)
    return v.col.isNotNull()


def text_of(v: Val) -> Column:
    """A value as text, null as null; whole doubles without a fraction."""
    if v.kind == "string":
        return v.col
    if is_float(v.dtype):
        whole = (F.floor(v.col) == v.col) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    if v.kind in ("array", "object"):
        return F.to_json(v.col)
    return v.col.cast("string")
