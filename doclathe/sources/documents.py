"""Sources and sinks: Python documents, JSON array files, Parquet and other formats of Spark's readers."""

from __future__ import annotations

import datetime
import decimal
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions.paths import HIDDEN, KEYS
from doclathe.functions.values import common_type


def type_of(x) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.LongType()
    if isinstance(x, (float, decimal.Decimal)):
        return T.DoubleType()
    if isinstance(x, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(x, datetime.datetime):
        return T.TimestampNTZType() if x.tzinfo is None else T.TimestampType()
    if isinstance(x, datetime.date):
        return T.DateType()
    if isinstance(x, (list, tuple)):
        of: T.DataType = T.NullType()
        for i in x:
            of = common_type(of, type_of(i))
        return T.ArrayType(of)
    if isinstance(x, dict):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in x.items()])
    return T.StringType()


def settled(t: T.DataType) -> T.DataType:
    """The type with strings for what no value told."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in t.fields])
    return t


def schema_of(docs) -> T.StructType:
    out = T.StructType([])
    for d in docs:
        try:
            out = common_type(out, type_of(d))
        except SpecError as e:
            raise SpecError(f"a field holds values of several types; load it as variants: {e}") from e
    return settled(out)


def shaped(x, t: T.DataType):
    """A Python value as createDataFrame wants it for a type."""
    if x is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(shaped(x.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [shaped(i, t.elementType) for i in x]
    if isinstance(t, T.DoubleType):
        return float(x)
    if isinstance(t, T.StringType):
        return x if isinstance(x, str) else str(x)
    if isinstance(t, T.BinaryType):
        return bytes(x)
    return x


def present(d, prefix: str = "") -> list[str]:
    """The dotted paths that a document has, null or not."""
    out = []
    for k, v in d.items():
        out.append(prefix + k)
        if isinstance(v, dict):
            out += present(v, f"{prefix}{k}.")
    return out


def from_dicts(spark: SparkSession, docs: list[dict], schema: T.StructType | None = None, presence: bool = False) -> DataFrame:
    """Documents as a frame.  presence: keep, hidden, which paths each document has, so that a null and a
    missing field differ in filters."""
    docs = list(docs)
    schema = schema or schema_of(docs)
    rows = [shaped(d, schema) for d in docs]
    if presence:
        schema = T.StructType([*schema.fields, T.StructField(KEYS, T.ArrayType(T.StringType()))])
        rows = [(*r, present(d)) for r, d in zip(rows, docs)]
    if not schema.fields:
        return spark.range(len(docs)).select()
    return spark.createDataFrame(rows, schema)


def from_variants(spark: SparkSession, docs: list[dict], fields: list[str]) -> DataFrame:
    """Documents whose fields may hold values of any type: each field is a VARIANT column."""
    rows = spark.createDataFrame([(json.dumps(d, default=str),) for d in docs], "j string")
    v = F.parse_json("j")
    return rows.select(*(F.try_variant_get(v, f"$.{f}", "variant").alias(f) for f in fields))


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """JSON array files, or any format that Spark reads; by default by the path's ending."""
    format = format or {"json": "json", "csv": "csv", "orc": "orc"}.get(path.rsplit(".", 1)[-1], "parquet")
    if format == "json":
        options = {"multiLine": True} | options
    return spark.read.format(format).options(**options).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options) -> None:
    df.drop(*[c for c in HIDDEN if c in df.columns]).write.format(format).mode(mode).options(**options).save(path)


def to_dicts(df: DataFrame) -> list[dict]:
    """All documents, on the driver."""
    return [r.asDict(True) for r in df.drop(*[c for c in HIDDEN if c in df.columns]).collect()]


def save_json(df: DataFrame, path: str) -> int:
    """A JSON array file on the driver's disk, written row by row; for large results use write()."""
    n = 0
    with open(path, "w") as f:
        f.write("[")
        for row in df.drop(*[c for c in HIDDEN if c in df.columns]).toJSON().toLocalIterator():
            f.write(",\n " * bool(n) + row)
            n += 1
        f.write("]\n")
    return n
