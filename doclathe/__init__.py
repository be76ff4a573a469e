"""A document query engine on Spark: declarative specs compiled to Columns and DataFrames.

    import doclathe as dl
    orders = dl.collection("orders", df)
    orders.find({"status": "A", "qty": {"$gte": 30}}).sort({"qty": -1}).limit(10).to_list()
    dl.aggregate(df, [{"$group": {"_id": "$status", "total": {"$sum": "$qty"}}}])
"""

from __future__ import annotations

from doclathe import functional
from doclathe.collection import Collection
from doclathe.context import Settings, SpecError, configure, reset, settings
from doclathe.extend import register_accumulator, register_expression, register_operator, register_stage
from doclathe.functional import *  # noqa: F403
from doclathe.functional import aggregate, copy_to, count, count_documents, distinct, estimated_document_count, find, find_one
from doclathe.object_id import ObjectId
from doclathe.plans.cursor import Cursor
from doclathe.sources import catalog
from doclathe.sources.documents import from_dicts, from_variants, read, save_json, to_dicts, write


def collection(name: str, source=None) -> Collection:
    """The named collection; with a source, made or replaced; else made empty if there is none."""
    if source is not None or not catalog.has(name):
        catalog.put(name, source if isinstance(source, Collection) else Collection(source))
    return catalog.get(name)
