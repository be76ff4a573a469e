"""The functional surface: queries over any frame (or list of documents), without a collection.

Reads return frames and are lazy; counts and single documents are actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclathe import collection as _collection
from doclathe.collection import Collection
from doclathe.functions.paths import Scope
from doclathe.operators.predicate import compile_filter
from doclathe.plans import cursor as _cursor
from doclathe.plans.pipeline import aggregate as _aggregate
from doclathe.sources import documents
from doclathe.sources.catalog import Environment


def frame(source) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Collection):
        return source.hidden_frame
    return documents.from_dicts(SparkSession.getActiveSession(), list(source))


def find(source, query=None, projection=None) -> DataFrame:
    return _cursor.find(frame(source), query, projection)


def find_one(source, query=None, projection=None) -> dict | None:
    rows = _cursor.find(frame(source), query, projection, limit=1).collect()
    return rows[0].asDict(True) if rows else None


def count(source, query=None) -> int:
    df = frame(source)
    return df.filter(compile_filter(query, Scope.of(df))).count() if query else df.count()


count_documents = count


def estimated_document_count(source) -> int:
    return frame(source).count()


def distinct(source, field: str, query=None) -> DataFrame:
    df = frame(source)
    return _collection.distinct(df.filter(compile_filter(query, Scope.of(df))) if query else df, field)


def aggregate(source, stages, index_stats=None, out=None) -> DataFrame:
    return _aggregate(frame(source), stages, Environment(index_stats, out))


def matches(document: dict, query) -> bool:
    """Whether one document matches; for tests and small checks."""
    spark = SparkSession.getActiveSession()
    df = documents.from_dicts(spark, [document], presence=True)
    return df.filter(compile_filter(query, Scope.of(df))).count() == 1


def copy_to(source, target: Collection) -> int:
    return (source if isinstance(source, Collection) else Collection(frame(source))).copy_to(target)


def _write(name: str):
    def run(source: Collection, *args, **options):
        if not isinstance(source, Collection):
            raise TypeError(f"{name} needs a Collection: frames are immutable")
        return getattr(source, name)(*args, **options)

    run.__name__ = name
    return run


WRITES = (
    "insert_one insert_many insert delete_one delete_many remove update_one update_many replace_one "
    "find_one_and_update find_one_and_replace find_one_and_delete bulk_write drop"
).split()
globals().update({n: _write(n) for n in WRITES})
