"""A facade shaped like a database driver, for code that talks to one: client, databases, collections, cursors.

Nothing is networked.  Databases are prefixes of the process-wide catalog; sessions run what they are given
and roll nothing back."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from doclathe.collection import Collection
from doclathe.object_id import ObjectId
from doclathe.operators.stages import STAGES
from doclathe.plans.cursor import Cursor
from doclathe.sources import catalog


class FindCursor:
    """A cursor that is read at most once; rewind() starts again."""

    def __init__(self, make: Callable[[], Cursor]):
        self._make, self._steps, self._maps = make, [], []
        self._rows: Iterator | None = None
        self._peeked: list = []

    def _step(self, name: str, *args) -> FindCursor:
        self._steps.append((name, args))
        return self

    def sort(self, spec, direction=None) -> FindCursor:
        return self._step("sort", spec, direction)

    def skip(self, n) -> FindCursor:
        return self._step("skip", n)

    def limit(self, n) -> FindCursor:
        return self._step("limit", n)

    def project(self, spec) -> FindCursor:
        return self._step("project", spec)

    def filter(self, query) -> FindCursor:
        return self._step("filter", query)

    def map(self, f) -> FindCursor:
        self._maps.append(f)
        return self

    def _inert(self, *_, **__) -> FindCursor:
        return self

    hint = batch_size = max_time_ms = comment = collation = allow_disk_use = add_cursor_flag = no_cursor_timeout = _inert

    def clone(self) -> FindCursor:
        new = FindCursor(self._make)
        new._steps, new._maps = list(self._steps), list(self._maps)
        return new

    def rewind(self) -> FindCursor:
        self._rows, self._peeked = None, []
        return self

    def _cursor(self) -> Cursor:
        c = self._make()
        for name, args in self._steps:
            if name == "filter":
                c._query = args[0]
            elif name == "sort":
                c.sort(*args)
            else:
                getattr(c, name)(*args)
        return c

    def __iter__(self) -> Iterator:
        while self.has_next():
            yield self.next()

    def has_next(self) -> bool:
        if self._rows is None:
            self._rows = iter(self._cursor())
        if not self._peeked:
            self._peeked = [d for d in [next(self._rows, None)] if d is not None]
        return bool(self._peeked)

    def next(self):
        if not self.has_next():
            return None
        d = self._peeked.pop()
        for f in self._maps:
            d = f(d)
        return d

    try_next = next

    def to_list(self) -> list:
        return list(self)

    def for_each(self, f) -> None:
        for d in self:
            f(d)

    def count(self) -> int:
        return self._cursor().count()

    def explain(self) -> dict:
        return self._cursor().explain()

    def close(self) -> None:
        self._rows = iter(())


class AggregationCursor:
    """A pipeline that grows by its methods until it is read."""

    def __init__(self, collection: Collection, stages: list[dict], options: dict | None = None):
        self._collection, self._stages, self._options = collection, stages, options or {}
        self._found: FindCursor | None = None

    def _add(self, stage: str, operand) -> AggregationCursor:
        if self._found is not None:
            raise ValueError("the cursor has been read")
        self._stages = [*self._stages, {stage: operand}]
        return self

    def __getattr__(self, name: str):
        first, *rest = name.split("_")
        stage = "$" + first + "".join(map(str.title, rest))
        if name.startswith("_") or stage not in STAGES:
            raise AttributeError(name)
        return lambda operand: self._add(stage, operand)

    def _cursor(self) -> FindCursor:
        if self._found is None:
            frame = self._collection.aggregate(self._stages, **self._options)
            self._found = FindCursor(lambda: Cursor(frame))
        return self._found

    def has_next(self) -> bool:
        return self._cursor().has_next()

    def next(self):
        return self._cursor().next()

    try_next = next

    def __iter__(self) -> Iterator:
        return iter(self._cursor())

    def to_list(self) -> list:
        return self._cursor().to_list()

    def for_each(self, f) -> None:
        self._cursor().for_each(f)

    def map(self, f) -> FindCursor:
        return self._cursor().map(f)

    def rewind(self) -> AggregationCursor:
        self._cursor().rewind()
        return self

    def clone(self) -> AggregationCursor:
        return AggregationCursor(self._collection, self._stages, self._options)

    def explain(self) -> dict:
        return self._cursor().explain()

    def close(self) -> None:
        self._cursor().close()


class ClientCollection:
    """A collection's methods; inserted documents without an _id get an ObjectId."""

    def __init__(self, db: Db, name: str):
        self.db, self.name = db, name

    @property
    def namespace(self) -> str:
        return f"{self.db.name}.{self.name}"

    @property
    def _inner(self) -> Collection:
        if not catalog.has(self.namespace):
            catalog.put(self.namespace, Collection([], presence=True))
        return catalog.get(self.namespace)

    def find(self, query=None, projection=None) -> FindCursor:
        return FindCursor(lambda: self._inner.find(query, projection))

    def aggregate(self, stages, **options) -> AggregationCursor:
        return AggregationCursor(self._inner, list(stages), options)

    @staticmethod
    def _with_id(doc: dict) -> dict:
        return doc if "_id" in doc else {"_id": str(ObjectId())} | doc

    def insert_one(self, doc: dict) -> dict:
        return self._inner.insert_one(self._with_id(doc))

    def insert_many(self, docs: list[dict]) -> dict:
        return self._inner.insert_many([self._with_id(d) for d in docs])

    def rename(self, name: str) -> ClientCollection:
        return self.db.rename_collection(self.name, name)

    def drop(self) -> bool:
        return catalog.drop(self.namespace)

    def watch(self, *_, **__):
        raise NotImplementedError("there are no change streams; use Structured Streaming")

    def create_search_index(self, *_, **__):
        raise NotImplementedError("there are no search indexes")

    list_search_indexes = update_search_index = drop_search_index = create_search_index

    def initialize_ordered_bulk_op(self) -> Bulk:
        return Bulk(self, True)

    def initialize_unordered_bulk_op(self) -> Bulk:
        return Bulk(self, False)

    def stats(self) -> dict:
        return {"ns": self.namespace, "count": self._inner.count(), "nindexes": len(self._inner.get_indexes()), "ok": 1}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._inner, name)


class Bulk:
    """Fluent bulk operations: find(query).update_one(…), insert(…), execute()."""

    def __init__(self, collection: ClientCollection, ordered: bool):
        self._collection, self._ordered, self._operations = collection, ordered, []

    def insert(self, doc: dict) -> Bulk:
        self._operations.append({"insertOne": {"document": ClientCollection._with_id(doc)}})
        return self

    def find(self, query) -> BulkFind:
        return BulkFind(self, query)

    def execute(self) -> dict:
        return self._collection._inner.bulk_write(self._operations, self._ordered)


class BulkFind:
    def __init__(self, bulk: Bulk, query):
        self._bulk, self._query, self._upsert = bulk, query, False

    def upsert(self) -> BulkFind:
        self._upsert = True
        return self

    def _put(self, kind: str, **spec) -> Bulk:
        self._bulk._operations.append({kind: {"filter": self._query} | spec})
        return self._bulk

    def update_one(self, update) -> Bulk:
        return self._put("updateOne", update=update, upsert=self._upsert)

    def update(self, update) -> Bulk:
        return self._put("updateMany", update=update, upsert=self._upsert)

    def replace_one(self, doc) -> Bulk:
        return self._put("replaceOne", replacement=doc, upsert=self._upsert)

    def delete_one(self) -> Bulk:
        return self._put("deleteOne")

    def delete(self) -> Bulk:
        return self._put("deleteMany")


class Db:
    def __init__(self, client: DocumentClient, name: str):
        self.client, self.name = client, name

    def collection(self, name: str) -> ClientCollection:
        return ClientCollection(self, name)

    __getitem__ = collection

    def create_collection(self, name: str) -> ClientCollection:
        c = self.collection(name)
        c._inner  # noqa: B018  makes it
        return c

    def _names(self) -> list[str]:
        return [n[len(self.name) + 1 :] for n in catalog.names() if n.startswith(self.name + ".")]

    def list_collections(self) -> list[dict]:
        return [{"name": n, "type": "collection"} for n in self._names()]

    def collections(self) -> list[ClientCollection]:
        return [self.collection(n) for n in self._names()]

    def drop_collection(self, name: str) -> bool:
        return catalog.drop(f"{self.name}.{name}")

    def rename_collection(self, old: str, new: str) -> ClientCollection:
        catalog.rename(f"{self.name}.{old}", f"{self.name}.{new}")
        return self.collection(new)

    def drop_database(self) -> bool:
        for n in self._names():
            catalog.drop(f"{self.name}.{n}")
        return True

    def command(self, spec: dict) -> dict:
        if "ping" in spec:
            return {"ok": 1}
        if "count" in spec:
            return {"ok": 1, "n": self.collection(spec["count"]).count(spec.get("query"))}
        if "distinct" in spec:
            return {"ok": 1, "values": self.collection(spec["distinct"]).distinct(spec["key"], spec.get("query"))}
        raise NotImplementedError(f"command {next(iter(spec), None)}")

    def stats(self) -> dict:
        names = self._names()
        return {"db": self.name, "collections": len(names), "objects": sum(self.collection(n).count() for n in names), "ok": 1}

    def admin(self) -> Admin:
        return Admin(self.client)


class Admin:
    def __init__(self, client: DocumentClient):
        self._client = client

    def ping(self) -> dict:
        return {"ok": 1}

    def list_databases(self) -> dict:
        return {"databases": [{"name": n} for n in self._client.names()], "ok": 1}

    def server_status(self) -> dict:
        return {"ok": 1, "process": "spark"}


class Session:
    """Runs what it is given; nothing is rolled back."""

    def with_transaction(self, f):
        return f(self)

    def start_transaction(self) -> None: ...

    def commit_transaction(self) -> None: ...

    def abort_transaction(self) -> None: ...

    def end_session(self) -> None: ...


class DocumentClient:
    def __init__(self, url: str = "local:///", **options):
        self.url, self.options = url, options
        path = url.split("//", 1)[-1]
        self.default = (path.split("/", 1)[1].split("?")[0] if "/" in path else "") or "test"
        self.connected = False

    def connect(self) -> DocumentClient:
        self.connected = True
        return self

    def close(self) -> None:
        self.connected = False

    def db(self, name: str | None = None) -> Db:
        return Db(self, name or self.default)

    __getitem__ = db

    def names(self) -> list[str]:
        return sorted({n.split(".", 1)[0] for n in catalog.names() if "." in n})

    def start_session(self) -> Session:
        return Session()

    @contextlib.contextmanager
    def session(self):
        yield Session()

    def watch(self, *_, **__):
        raise NotImplementedError("there are no change streams; use Structured Streaming")
