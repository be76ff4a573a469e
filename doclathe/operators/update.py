"""Update documents to new Columns.

An update is a fold over the fields of a row: each operator changes the value at a path, in the order in
which the spec gives them.  What a row was and whether it is hit stay with the caller."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import values
from doclathe.functions.paths import Scope, drop_path, set_path
from doclathe.functions.values import NULL, Val, coerce, common_type, equal, literal, missing, sure
from doclathe.operators.predicate import compile_filter, element_filter, field_filter, has_operators
from doclathe.operators.projection import element_condition

Fields = dict[str, Val]
#: name -> f(value, operand) giving the new value; run for each path of the operator.
VALUE: dict[str, Callable[[Val, object], Val]] = {}


def is_update(spec) -> bool:
    """Whether a document consists of operators; mixing them with fields is an error."""
    if not isinstance(spec, dict):
        raise SpecError("an update is an object")
    ops = [k for k in spec if k.startswith("$")]
    if ops and len(ops) < len(spec):
        raise SpecError("an update can't mix operators and fields")
    return bool(ops)


def value_operator(name: str):
    def put(f):
        VALUE[name] = f
        return f

    return put


@value_operator("$set")
def _set(v: Val, x) -> Val:
    return literal(x, v.dtype)


def _number(v: Val, name: str) -> Val:
    if v.kind == "null":
        return literal(0)
    if v.kind != "number":
        raise SpecError(f"{name} needs a number, not a {v.kind}")
    return Val(F.coalesce(v.col, F.lit(0)), v.dtype)


def _arith(v: Val, x, f, name: str) -> Val:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise SpecError(f"{name} needs a number")
    a, b = _number(v, name), literal(x)
    to = T.LongType() if values.is_integral(a.dtype) and values.is_integral(b.dtype) else T.DoubleType()
    return Val(f(a.col.cast(to), b.col.cast(to)), to)


VALUE["$inc"] = lambda v, x: _arith(v, x, lambda a, b: a + b, "$inc")
VALUE["$mul"] = lambda v, x: _arith(v, x, lambda a, b: a * b, "$mul")


def _extreme(v: Val, x, f) -> Val:
    new = literal(x)
    if v.kind == "null" or not values.comparable(v, new):
        return Val(F.coalesce(v.col, coerce(new, v.dtype)), v.dtype) if v.kind == new.kind else new if v.kind == "null" else v
    to = common_type(v.dtype, new.dtype)
    return Val(f(coerce(v, to), coerce(new, to)), to)


VALUE["$min"] = lambda v, x: _extreme(v, x, F.least)
VALUE["$max"] = lambda v, x: _extreme(v, x, F.greatest)


@value_operator("$currentDate")
def _current_date(v: Val, x) -> Val:
    if x is not True and x != {"$type": "date"}:
        raise SpecError("$currentDate needs true or {$type: date}")
    now = F.current_timestamp()
    return Val(now.cast("timestamp_ntz"), T.TimestampNTZType()) if isinstance(v.dtype, T.TimestampNTZType) else Val(now, T.TimestampType())


@value_operator("$bit")
def _bit(v: Val, x) -> Val:
    out = _number(v, "$bit").col.cast("long")
    for op, n in x.items():
        mask = F.lit(n).cast("long")
        if op not in ("and", "or", "xor"):
            raise SpecError(f"unknown $bit operation {op}")
        out = {"and": out.bitwiseAND, "or": out.bitwiseOR, "xor": out.bitwiseXOR}[op](mask)
    return Val(out, T.LongType())


def _list(v: Val, name: str, of: T.DataType = NULL) -> Val:
    """The array, empty if missing, with elements that can hold ``of`` too."""
    if v.kind == "null":
        return Val(F.array().cast(T.ArrayType(of)), T.ArrayType(of))
    if v.kind != "array":
        raise SpecError(f"{name} needs an array, not a {v.kind}")
    to = T.ArrayType(common_type(v.dtype.elementType, of))
    return Val(F.coalesce(coerce(v, to), F.array().cast(to)), to)


def _each(x) -> tuple[list, dict]:
    if isinstance(x, dict) and "$each" in x:
        return list(x["$each"]), {k: o for k, o in x.items() if k != "$each"}
    return [x], {}


def sort_array(v: Val, spec) -> Val:
    of = v.dtype.elementType
    keys = list(spec.items()) if isinstance(spec, dict) else [(None, spec)]
    if any(d not in (1, -1) for _, d in keys):
        raise SpecError("$sort's direction is 1 or -1")

    def key(e: Column, path) -> Val:
        out = Val(e, of)
        for n in path.split(".") if path else ():
            out = values.field(out, n)
        return out

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, d in reversed(keys):
            x, y = key(a, path), key(b, path)
            if x.kind == "null":
                continue
            less, more = sure(x.col < y.col) | (x.col.isNull() & y.col.isNotNull()), sure(x.col > y.col) | (x.col.isNotNull() & y.col.isNull())
            out = F.when(less, -d).when(more, d).otherwise(out)
        return out

    return Val(F.array_sort(v.col, order), v.dtype)


@value_operator("$push")
def _push(v: Val, x) -> Val:
    items, more = _each(x)
    unknown = set(more) - {"$position", "$sort", "$slice"}
    if unknown:
        raise SpecError(f"unknown $push modifiers {sorted(unknown)}")
    new = literal(items)
    old = _list(v, "$push", new.dtype.elementType)
    added = coerce(new, old.dtype) if items else F.array().cast(old.dtype)
    if "$position" in more:
        p, n = more["$position"], F.size(old.col)
        at = F.least(F.lit(p), n) if p >= 0 else F.greatest(n + p, F.lit(0))
        out = F.concat(F.slice(old.col, F.lit(1), at), added, F.slice(old.col, at + 1, n))
    else:
        out = F.concat(old.col, added)
    result = Val(out, old.dtype)
    if "$sort" in more:
        result = sort_array(result, more["$sort"])
    if "$slice" in more:
        k = more["$slice"]
        start = F.lit(1) if k >= 0 else F.greatest(F.size(result.col) + k, F.lit(0)) + 1
        result = Val(F.slice(result.col, start, F.lit(abs(k))), result.dtype)
    return result


@value_operator("$addToSet")
def _add_to_set(v: Val, x) -> Val:
    items, _ = _each(x)
    new = literal(items)
    old = _list(v, "$addToSet", new.dtype.elementType)
    of = old.dtype.elementType
    out = old.col
    for i in items:
        item = literal(i)
        out = F.when(sure(F.exists(out, _is(of, item))), out).otherwise(F.concat(out, F.array(coerce(item, of))))
    return Val(out, old.dtype)


def _is(of: T.DataType, item: Val):
    return lambda e: equal(Val(e, of), item)


@value_operator("$pop")
def _pop(v: Val, x) -> Val:
    if x not in (1, -1):
        raise SpecError("$pop needs 1 or -1")
    if v.kind == "null":
        return v
    a = _list(v, "$pop")
    kept = F.slice(a.col, 1 if x == 1 else 2, F.greatest(F.size(a.col) - 1, F.lit(0)))
    return Val(F.when(v.col.isNotNull(), kept), a.dtype)


@value_operator("$pull")
def _pull(v: Val, x) -> Val:
    if v.kind == "null":
        return v
    a = _list(v, "$pull")
    of = a.dtype.elementType
    if isinstance(x, dict):
        test = lambda e: ~sure(element_filter(Val(e, of), x, Scope({})))
    else:
        test = lambda e: ~equal(Val(e, of), literal(x))
    return Val(F.when(v.col.isNotNull(), F.filter(a.col, test)), a.dtype)


@value_operator("$pullAll")
def _pull_all(v: Val, x) -> Val:
    if v.kind == "null":
        return v
    a = _list(v, "$pullAll")
    of = a.dtype.elementType

    def stays(e: Column) -> Column:
        out = F.lit(True)
        for i in x:
            out = out & ~equal(Val(e, of), literal(i))
        return out

    return Val(F.when(v.col.isNotNull(), F.filter(a.col, stays)), a.dtype)


class Update:
    """Compiles an update for rows of a scope.  query and array_filters bind positional paths."""

    def __init__(self, scope: Scope, query=None, array_filters=None):
        self.scope, self.query = scope, query or {}
        self.fields: Fields = dict(scope.fields)
        self.added: list[str] = []
        self.removed: list[str] = []
        self.filters: dict[str, dict] = {}
        for f in array_filters or []:
            for k, c in f.items():
                name, _, rest = k.partition(".")
                self.filters.setdefault(name, {})[rest] = c

    def at(self, path: str, change: Callable[[Val], Val]) -> None:
        names = path.split(".")
        first = names[0]
        self.fields[first] = self._down(self.fields.get(first, missing()), names[1:], change, first)
        if not any(n.startswith("$") for n in names):
            self.added += [".".join(names[: i + 1]) for i in range(len(names))]

    def _down(self, v: Val, names: list[str], change, so_far: str) -> Val:
        """Positional names first; the plain ones between them by set_path."""
        for i, n in enumerate(names):
            if n.startswith("$"):
                here = ".".join([so_far, *names[:i]])
                return set_path(v, names[:i], lambda a: self._elements(a, n, names[i + 1 :], change, here))
        return set_path(v, names, change)

    def _elements(self, a: Val, name: str, rest: list[str], change, path: str) -> Val:
        if a.kind == "null":
            return a
        if a.kind != "array":
            raise SpecError(f"{path}.{name} needs an array")
        of = a.dtype.elementType
        new_type = self._down(Val(F.lit(None).cast(of), of), rest, change, path).dtype
        to = common_type(of, new_type)

        def new(e: Column) -> Column:
            return coerce(self._down(Val(e, of), rest, change, path), to)

        def old(e: Column) -> Column:
            return coerce(Val(e, of), to)

        if name == "$[]":
            return Val(F.transform(a.col, new), T.ArrayType(to))
        if name == "$":
            cond = element_condition(self.query, path)
            if cond is None:
                raise SpecError(f"the positional operator needs a condition on {path}")
            at = F.array_position(F.transform(a.col, lambda e: sure(element_filter(Val(e, of), cond, self.scope))), True) - 1
            return Val(F.transform(a.col, lambda e, i: F.when(i == at, new(e)).otherwise(old(e))), T.ArrayType(to))
        if name.startswith("$[") and name.endswith("]"):
            wanted = self.filters.get(name[2:-1])
            if wanted is None:
                raise SpecError(f"no array filter for {name}")

            def hit(e: Column) -> Column:
                out = F.lit(True)
                for p, c in wanted.items():
                    if p:
                        out = out & sure(compile_filter({p: c}, Scope({}).inside(Val(e, of)), True))
                    else:
                        out = out & sure(field_filter(Val(e, of), c, self.scope, True))
                return out

            return Val(F.transform(a.col, lambda e: F.when(hit(e), new(e)).otherwise(old(e))), T.ArrayType(to))
        raise SpecError(f"unknown positional operator {name}")

    def unset(self, path: str) -> None:
        """The value becomes null; the column stays, as other rows have it."""
        if any(n.startswith("$") for n in path.split(".")):
            self.at(path, lambda v: Val(F.lit(None).cast(v.dtype), v.dtype))
        elif self.scope.get(path).kind != "null" or path in self.fields:
            self.at(path, lambda v: Val(F.lit(None).cast(v.dtype), v.dtype))
            self.added = [p for p in self.added if p != path and not p.startswith(path + ".")]
            self.removed.append(path)

    def rename(self, old: str, new: str) -> None:
        now = Scope(self.fields)
        source, target = now.get(old), now.get(new)
        if source.kind == "null":
            return
        to = common_type(source.dtype, target.dtype) if target.kind != "null" else source.dtype
        moved = Val(F.coalesce(coerce(source, to), coerce(target, to)), to)
        self.at(new, lambda _: moved)
        self.unset(old)

    def apply(self, spec: dict) -> Update:
        if not is_update(spec):
            raise SpecError("an update needs operators")
        for op, operand in spec.items():
            if op == "$setOnInsert":
                continue
            if not isinstance(operand, dict):
                raise SpecError(f"{op} needs an object")
            for path, x in operand.items():
                if op == "$unset":
                    self.unset(path)
                elif op == "$rename":
                    self.rename(path, x)
                elif op in VALUE:
                    self.at(path, lambda v, op=op, x=x: VALUE[op](v, x))
                else:
                    raise SpecError(f"unknown update operator {op}")
        return self


def changed_columns(scope: Scope, update: Update, hit: Column) -> tuple[Fields, Column]:
    """All fields after the update of rows that are hit, and whether such a row differs from before."""
    out: Fields = {}
    differs = F.lit(False)
    for n, new in update.fields.items():
        old = scope.fields.get(n, missing())
        if new is old:
            out[n] = old
            continue
        to = common_type(old.dtype, new.dtype)
        out[n] = Val(F.when(hit, coerce(new, to)).otherwise(coerce(old, to)), to)
        differs = differs | ~equal(old, new)
    return out, differs


def _get(doc: dict, path: str):
    at = doc
    for n in path.split("."):
        if not isinstance(at, dict) or n not in at:
            return None
        at = at[n]
    return at


def _put(doc: dict, path: str, value) -> None:
    *parents, last = path.split(".")
    for n in parents:
        doc = doc.setdefault(n, {})
    doc[last] = value


def seed_of(query) -> dict:
    """The fields that a query's equalities fix."""
    out: dict = {}
    for k, c in query.items() if isinstance(query, dict) else ():
        if k.startswith("$"):
            continue
        if isinstance(c, dict):
            if list(c) == ["$eq"]:
                _put(out, k, c["$eq"])
        else:
            _put(out, k, c)
    return out


def upsert_document(query, update: dict) -> dict:
    """The document that an upsert inserts; of one document, so made on the driver."""
    doc = seed_of(query)
    if not is_update(update):
        return dict(update) | {k: v for k, v in doc.items() if k not in update}
    for op, operand in update.items():
        for path, x in operand.items():
            old = _get(doc, path)
            if op in ("$set", "$setOnInsert"):
                continue
            if op == "$inc":
                _put(doc, path, (old or 0) + x)
            elif op == "$mul":
                _put(doc, path, (old or 0) * x)
            elif op in ("$min", "$max"):
                _put(doc, path, x if old is None else min(old, x) if op == "$min" else max(old, x))
            elif op == "$currentDate":
                _put(doc, path, datetime.datetime.now(datetime.timezone.utc))
            elif op == "$bit":
                n = old or 0
                for o, m in x.items():
                    n = n & m if o == "and" else n | m if o == "or" else n ^ m
                _put(doc, path, n)
            elif op == "$push":
                items, more = _each(x)
                a = list(old or [])
                p = more.get("$position", len(a))
                a[p:p] = items
                if "$sort" in more:
                    for k, d in reversed(list(more["$sort"].items()) if isinstance(more["$sort"], dict) else [(None, more["$sort"])]):
                        a.sort(key=lambda e, k=k: ((e.get(k) if k else e) is not None, (e.get(k) if k else e) or 0), reverse=d < 0)
                if "$slice" in more:
                    n = more["$slice"]
                    a = a[:n] if n >= 0 else a[n:]
                _put(doc, path, a)
            elif op == "$addToSet":
                a = list(old or [])
                a += [i for j, i in enumerate(_each(x)[0]) if i not in a and i not in _each(x)[0][:j]]
                _put(doc, path, a)
            elif op == "$rename" and old is not None:
                _put(doc, x, old)
                _drop(doc, path)
            elif op == "$unset":
                _drop(doc, path)
        if op == "$set":
            for path, x in operand.items():
                _put(doc, path, x)
    for path, x in update.get("$setOnInsert", {}).items():
        _put(doc, path, x)
    return doc


def _drop(doc: dict, path: str) -> None:
    *parents, last = path.split(".")
    for n in parents:
        doc = doc.get(n, {})
    if isinstance(doc, dict):
        doc.pop(last, None)


__all__ = ["Update", "changed_columns", "drop_path", "has_operators", "is_update", "upsert_document"]
