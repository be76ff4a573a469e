"""Collections: an immutable frame that writes swap for a new one.

A hidden column holds the order of arrival.  A write is one new lazy frame and one aggregate for its
report; the lineage is cut by a table in the shared folder every ``CHECKPOINT`` writes.  A write of one
document needs row numbers that are the same in every job, so the first one writes the frame out as well."""

from __future__ import annotations

import itertools
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError, settings
from doclathe.functions.paths import HIDDEN, KEYS, ORD, Scope, to_columns
from doclathe.functions.values import coerce, common_type, equal, literal, missing, sure
from doclathe.operators.predicate import compile_filter
from doclathe.operators.stages import with_order
from doclathe.operators.update import Update, changed_columns, is_update, upsert_document
from doclathe.plans.cursor import Cursor, find
from doclathe.plans.pipeline import aggregate
from doclathe.sources import documents
from doclathe.sources.catalog import Environment
from doclathe.sources.documents import type_of
from doclathe.sources.scratch import snapshot

CHECKPOINT = 20
BULK = ("insertOne", "updateOne", "updateMany", "deleteOne", "deleteMany", "replaceOne")
_sequence = itertools.count(1)


def new_id() -> str:
    return f"doc_{int(time.time() * 1000):x}_{next(_sequence):x}"


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; fields of either, in types that hold both."""
    if not a.columns:
        return b
    names = [*a.columns, *(c for c in b.columns if c not in a.columns)]
    types = {n: common_type(a.schema[n].dataType if n in a.columns else T.NullType(), b.schema[n].dataType if n in b.columns else T.NullType()) for n in names}

    def side(df: DataFrame) -> DataFrame:
        from doclathe.functions.values import Val

        return df.select(*(coerce(Val(F.col(f"`{n}`"), df.schema[n].dataType) if n in df.columns else missing(), types[n]).alias(n) for n in names))

    return side(a).unionByName(side(b))


class Collection:
    """Over a frame, or Python documents.  presence: tell null from missing fields (Python documents only)."""

    def __init__(self, source=None, spark: SparkSession | None = None, presence: bool = False, options: dict | None = None):
        self.spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession())
        self.presence, self.options = presence, options or {}
        self._indexes: dict[str, dict] = {}
        self._writes = 0
        #: Whether the order of arrival is stored, so that each job sees the same numbers.
        self._pinned = False
        self._frame = self._load(source)

    def _load(self, source) -> DataFrame:
        if isinstance(source, DataFrame):
            return with_order(source)
        docs = list(source or [])
        if any(not isinstance(d, dict) for d in docs):
            raise TypeError("documents are dicts")
        df = documents.from_dicts(self.spark, docs, presence=self.presence) if docs else self.spark.createDataFrame([], T.StructType([]))
        return with_order(df)

    @property
    def hidden_frame(self) -> DataFrame:
        return self._frame

    @property
    def frame(self) -> DataFrame:
        """The documents now, as a lazy frame."""
        return self._frame.drop(*[c for c in HIDDEN if c in self._frame.columns])

    def replace(self, df: DataFrame) -> None:
        self._pinned = False
        self._swap(with_order(df.drop(*[c for c in HIDDEN if c in df.columns])))

    def _swap(self, df: DataFrame) -> None:
        self._writes += 1
        self._frame = df
        if self._writes % CHECKPOINT == 0:
            self._frame, self._pinned = snapshot(df), True

    def _pin(self) -> None:
        """Numbers made on the fly depend on how a job cuts its partitions; stored ones don't."""
        if not self._pinned:
            self._frame, self._pinned = snapshot(self._frame), True

    # Reads

    def find(self, query=None, projection=None) -> Cursor:
        return Cursor(self._frame, query, projection, {"access": self._access(query)})

    def find_one(self, query=None, projection=None) -> dict | None:
        rows = find(self._frame, query, projection, limit=1).collect()
        return rows[0].asDict(True) if rows else None

    def count(self, query=None) -> int:
        self._access(query)
        return self._frame.filter(compile_filter(query, Scope.of(self._frame))).count() if query else self._frame.count()

    count_documents = count

    def estimated_document_count(self) -> int:
        return self._frame.count()

    def distinct_frame(self, field: str, query=None) -> DataFrame:
        df = self._frame.filter(compile_filter(query, Scope.of(self._frame))) if query else self._frame
        return distinct(df, field)

    def distinct(self, field: str, query=None) -> list:
        return [r[0] for r in self.distinct_frame(field, query).collect()]

    def aggregate(self, stages, **options) -> DataFrame:
        return aggregate(self._frame, stages, Environment(self.index_stats(), options.get("out")))

    def to_list(self) -> list[dict]:
        return self.find().to_list()

    # Inserts

    def _append(self, docs: list[dict]) -> None:
        fresh = documents.from_dicts(self.spark, docs, presence=KEYS in self._frame.columns or (self.presence and not self.frame.columns))
        # Later rows come after all that are there; ids need not be gapless.
        top = self._frame.agg(F.max(ORD)).first()[0]
        fresh = fresh.withColumn(ORD, F.monotonically_increasing_id() + F.lit((top if top is not None else -1) + 1))
        self._swap(union(self._frame, fresh) if self._frame.columns != [ORD] else fresh)

    def _stamped(self, doc: dict) -> dict:
        return doc if "_id" in doc or not settings().auto_id else {"_id": new_id()} | doc

    def insert_one(self, doc: dict) -> dict:
        doc = self._stamped(doc)
        self._append([doc])
        return {"acknowledged": True, "insertedId": doc.get("_id"), "insertedCount": 1}

    def insert_many(self, docs: list[dict]) -> dict:
        if not isinstance(docs, (list, tuple)):
            raise TypeError("insert_many needs a list")
        docs = [self._stamped(d) for d in docs]
        if docs:
            self._append(docs)
        return {"acknowledged": True, "insertedCount": len(docs), "insertedIds": {i: d.get("_id") for i, d in enumerate(docs)}}

    def insert(self, source) -> dict:
        return self.insert_many(source) if isinstance(source, (list, tuple)) else self.insert_one(source)

    # Deletes

    def _hit(self, query, one: bool):
        """Which rows a write touches; of several only the first for a write of one."""
        if one:
            self._pin()
        hit = sure(compile_filter(query, Scope.of(self._frame)))
        if one:
            first = self._frame.filter(hit).agg(F.min(ORD)).first()[0]
            hit = hit & (F.col(ORD) == F.lit(first)) if first is not None else F.lit(False)
        return hit

    def _delete(self, query, one: bool) -> int:
        hit = self._hit(query, one)
        n = self._frame.filter(hit).count()
        if n:
            self._swap(self._frame.filter(~hit))
        return n

    def delete_one(self, query) -> dict:
        return {"acknowledged": True, "deletedCount": self._delete(query, True)}

    def delete_many(self, query) -> dict:
        return {"acknowledged": True, "deletedCount": self._delete(query, False)}

    def remove(self, query, just_one: bool = False) -> dict:
        return {"nRemoved": self._delete(query, just_one)}

    def drop(self) -> bool:
        self._frame = self._frame.limit(0)
        self._indexes.clear()
        return True

    # Updates

    def _update(self, query, spec: dict, one: bool, upsert: bool, array_filters) -> dict:
        if not is_update(spec):
            raise SpecError("an update needs operators; use replace_one for a whole document")
        scope = Scope.of(self._frame)
        report = {"acknowledged": True, "matchedCount": 0, "modifiedCount": 0, "upsertedCount": 0, "upsertedId": None}
        hit = self._hit(query, one)
        if upsert and not self._frame.filter(hit).limit(1).count():
            report |= self._upsert(query, spec)
        else:
            up = Update(scope, query if isinstance(query, dict) else None, array_filters).apply(spec)
            fields, differs = changed_columns(scope, up, hit)
            if "$push" in spec:
                differs = F.lit(True)  # a push always counts as a change
            keys = []
            if KEYS in self._frame.columns:
                now = F.array_distinct(F.concat(F.filter(F.col(KEYS), lambda p: ~_below(p, up.removed)), F.array(*map(F.lit, up.added)).cast("array<string>")))
                keys = [F.when(hit, now).otherwise(F.col(KEYS)).alias(KEYS)]
            counts = self._frame.filter(hit).agg(F.count(F.lit(1)), F.count_if(differs)).first()
            report["matchedCount"], report["modifiedCount"] = counts
            if counts[0]:
                self._swap(self._frame.select(*to_columns(fields), *keys, F.col(ORD)))
        return report

    def _upsert(self, query, spec: dict) -> dict:
        doc = self._stamped(upsert_document(query, spec))
        self._append([doc])
        return {"upsertedCount": 1, "upsertedId": doc.get("_id")}

    def update_one(self, query, update: dict, upsert: bool = False, array_filters=None) -> dict:
        return self._update(query, update, True, upsert, array_filters)

    def update_many(self, query, update: dict, upsert: bool = False, array_filters=None) -> dict:
        return self._update(query, update, False, upsert, array_filters)

    def replace_one(self, query, doc: dict, upsert: bool = False, _keep_id: bool = True) -> dict:
        if is_update(doc):
            raise SpecError("a replacement has no operators")
        report = {"acknowledged": True, "matchedCount": 0, "modifiedCount": 0, "upsertedCount": 0, "upsertedId": None}
        hit = self._hit(query, True)
        if not self._frame.filter(hit).limit(1).count():
            return report | (self._upsert(query, doc) if upsert else {})
        scope = Scope.of(self._frame)
        if _keep_id and "_id" in scope.fields and "_id" in doc:
            other = self._frame.filter(hit).filter(~equal(scope.fields["_id"], literal(doc["_id"]))).filter(scope.fields["_id"].col.isNotNull())
            if other.limit(1).count():
                raise SpecError("_id can't be changed by a replacement")
        up = Update(scope)
        for name, old in scope.fields.items():
            if name in doc:
                up.fields[name] = literal(doc[name], old.dtype)
            elif name != "_id" or not _keep_id:
                up.fields[name] = missing()
        for name in doc:
            if name not in scope.fields:
                up.fields[name] = literal(doc[name])
        fields, differs = changed_columns(scope, up, hit)
        keys = []
        if KEYS in self._frame.columns:
            there = documents.present(doc) + (["_id"] if _keep_id and "_id" not in doc and "_id" in scope.fields else [])
            keys = [F.when(hit, F.array(*map(F.lit, there)).cast("array<string>")).otherwise(F.col(KEYS)).alias(KEYS)]
        report |= {"matchedCount": 1, "modifiedCount": self._frame.filter(hit).filter(differs).count()}
        self._swap(self._frame.select(*to_columns(fields), *keys, F.col(ORD)))
        return report

    # Find and modify: the document as it was before.

    def find_one_and_update(self, query, update: dict, upsert: bool = False, array_filters=None) -> dict | None:
        self._pin()
        before = self.find_one(query)
        self.update_one(query, update, upsert, array_filters)
        return before

    def find_one_and_replace(self, query, doc: dict, upsert: bool = False) -> dict | None:
        self._pin()
        before = self.find_one(query)
        self.replace_one(query, doc, upsert, _keep_id=False)
        return before

    def find_one_and_delete(self, query) -> dict | None:
        self._pin()
        before = self.find_one(query)
        self.delete_one(query)
        return before

    def bulk_write(self, operations: list[dict], ordered: bool = True) -> dict:
        if not isinstance(operations, (list, tuple)):
            raise TypeError("bulk_write needs a list")
        out = {"acknowledged": True, "insertedCount": 0, "matchedCount": 0, "modifiedCount": 0, "deletedCount": 0, "upsertedCount": 0, "insertedIds": {}, "upsertedIds": {}}
        errors = []
        waiting: list[tuple[int, dict]] = []  # inserts that follow each other are one write

        def flush() -> None:
            if waiting:
                done = self.insert_many([d for _, d in waiting])["insertedIds"]
                out["insertedCount"] += len(waiting)
                out["insertedIds"].update({i: done[k] for k, (i, _) in enumerate(waiting)})
                waiting.clear()

        for i, op in enumerate(operations):
            if not isinstance(op, dict) or len(op) != 1 or next(iter(op)) not in BULK:
                raise SpecError(f"bulk operation {i} has exactly one of {', '.join(BULK)}")
            ((kind, spec),) = op.items()
            try:
                if kind == "insertOne":
                    type_of(spec["document"])  # what can't be stored fails here, alone
                    waiting.append((i, spec["document"]))
                else:
                    flush()
                    self._bulk(kind, spec, out, i)
            except Exception as e:
                if ordered:
                    flush()
                    raise
                errors.append({"index": i, "errmsg": str(e)})
        flush()
        return out | ({"writeErrors": errors} if errors else {})

    def _bulk(self, kind: str, spec: dict, out: dict, i: int) -> None:
        if kind in ("updateOne", "updateMany"):
            r = self._update(spec["filter"], spec["update"], kind == "updateOne", bool(spec.get("upsert")), spec.get("arrayFilters"))
        elif kind == "replaceOne":
            r = self.replace_one(spec["filter"], spec["replacement"], bool(spec.get("upsert")))
        else:
            r = self.delete_one(spec["filter"]) if kind == "deleteOne" else self.delete_many(spec["filter"])
        for k in ("matchedCount", "modifiedCount", "deletedCount", "upsertedCount"):
            out[k] += r.get(k, 0)
        if r.get("upsertedCount"):
            out["upsertedIds"][i] = r["upsertedId"]

    def copy_to(self, target: Collection) -> int:
        n = self._frame.count()
        top = target._frame.agg(F.max(ORD)).first()[0]
        fresh = self._frame.withColumn(ORD, F.col(ORD) + F.lit((top if top is not None else -1) + 1))
        target._pinned = target._pinned and self._pinned
        target._swap(union(target._frame, fresh) if target._frame.columns != [ORD] else fresh)
        return n

    # Indexes: names and statistics only.  Spark prunes by Parquet statistics instead.

    def create_index(self, spec) -> str:
        spec = {spec: 1} if isinstance(spec, str) else dict(spec)
        name = "_".join(f"{f}_{d}" for f, d in spec.items())
        self._indexes.setdefault(name, {"v": 2, "key": spec, "name": name, "ops": 0})
        return name

    def create_indexes(self, specs: list) -> list[str]:
        return [self.create_index(s["key"] if isinstance(s, dict) and "key" in s else s) for s in specs]

    def drop_index(self, name) -> dict:
        if isinstance(name, dict):
            name = "_".join(f"{f}_{d}" for f, d in name.items())
        self._indexes.pop(name, None) or self._indexes.pop(f"{name}_1", None)
        return {"ok": 1}

    def drop_indexes(self) -> bool:
        self._indexes.clear()
        return True

    def get_indexes(self) -> list[str]:
        return list(self._indexes)

    def indexes(self) -> list[dict]:
        return [{k: i[k] for k in ("v", "key", "name")} for i in self._indexes.values()]

    list_indexes = indexes

    def index_information(self) -> dict:
        return {n: [[f, d] for f, d in i["key"].items()] for n, i in self._indexes.items()}

    def index_exists(self, names) -> bool:
        return all(n in self._indexes for n in ([names] if isinstance(names, str) else names))

    def index_stats(self) -> list[dict]:
        return [{"name": n, "key": i["key"], "accesses": {"ops": i["ops"]}} for n, i in self._indexes.items()]

    def reindex(self) -> Collection:
        return self

    def _access(self, query) -> str:
        """Counts the indexes that a filter could have used; the plan is Spark's all the same."""
        names = self._usable(query)
        for n in names:
            self._indexes[n]["ops"] += 1
        return f"index {', '.join(names)}, by scan with pushed filters" if names else "scan"

    def _usable(self, query) -> list[str]:
        """The index whose leading fields a filter bounds, the longest such prefix first; of an $or without other
        conditions one for each branch, if all have one."""
        if not isinstance(query, dict):
            return []
        if list(query) == ["$or"] and isinstance(query["$or"], (list, tuple)):
            each = [self._usable(q) for q in query["$or"]]
            return list(dict.fromkeys(n for names in each for n in names)) if each and all(each) else []
        fixed = {f for f, c in query.items() if not f.startswith("$") and _bounds(c, {"$eq"})}
        ranged = {f for f, c in query.items() if not f.startswith("$") and _bounds(c, {"$eq", "$in", "$gt", "$gte", "$lt", "$lte"})}

        def prefix(index: dict) -> int:
            n = 0
            for f in index["key"]:
                if f not in fixed:
                    return n + (f in ranged)
                n += 1
            return n

        best = max(self._indexes.values(), key=prefix, default=None)
        return [best["name"]] if best and prefix(best) else []


def _bounds(condition, operators: set[str]) -> bool:
    """Whether a field's condition is a value, or made of the given operators."""
    if isinstance(condition, re.Pattern):
        return False
    if isinstance(condition, dict) and any(k.startswith("$") for k in condition):
        return set(condition) <= operators
    return True


def _below(p, removed: list[str]):
    out = F.lit(False)
    for r in removed:
        out = out | (p == r) | p.startswith(r + ".")
    return out


def distinct(df: DataFrame, field: str) -> DataFrame:
    """The different values of a field, arrays by their elements, as column ``value``."""
    scope = Scope.of(df)
    v = scope.get(field)
    if v.kind == "null":
        return df.select(F.lit(None).cast("string").alias("value")).limit(0)
    if scope.keys is not None:
        df = df.filter(F.array_contains(scope.keys, field))
    elif v.kind != "array":
        df = df.filter(v.col.isNotNull())
    c = F.explode(v.col) if v.kind == "array" else v.col
    return df.select(c.alias("value")).distinct()
