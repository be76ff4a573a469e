"""Dotted paths: where a spec's names point to, and how nested fields are set, kept and dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import values
from doclathe.functions.values import NULL, Val, missing

#: Columns that carry bookkeeping, not fields of documents: order of arrival, paths present, text score.
ORD, KEYS, SCORE = "_ord", "_keys", "_text_score"
HIDDEN = (ORD, KEYS, SCORE)


@dataclass
class Scope:
    """What names mean: the fields of a frame's rows or of an object, and variables."""

    fields: dict[str, Val]
    variables: dict[str, Val] = dc_field(default_factory=dict)
    keys: Column | None = None
    whole: Val | None = None
    #: Set by a $text filter: the score of the search that was compiled last.
    score: list = dc_field(default_factory=list)

    @staticmethod
    def of(df: DataFrame) -> Scope:
        columns = {f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        keys = columns[KEYS].col if KEYS in columns else None
        return Scope({k: v for k, v in columns.items() if k not in HIDDEN}, keys=keys)

    def inside(self, v: Val) -> Scope:
        """The scope in which an element's own fields are the names."""
        names = {n: values.field(v, n) for n in v.dtype.names} if isinstance(v.dtype, T.StructType) else {}
        return Scope(names, self.variables, whole=v, score=self.score)

    def bind(self, **more: Val) -> Scope:
        return Scope(self.fields, self.variables | more, self.keys, self.whole, self.score)

    def get(self, path: str) -> Val:
        if path in self.fields:
            return self.fields[path]
        first, *rest = path.split(".")
        v = self.fields.get(first) or (values.field(self.whole, first) if self.whole is not None and first not in self.fields else missing())
        for name in rest:
            v = values.field(v, name)
        return v

    def document(self) -> Val:
        return values.struct(self.fields) if self.whole is None else self.whole


def set_path(v: Val, names: list[str], change: Callable[[Val], Val]) -> Val:
    """The object v with the value at names[0].names[1]… changed; objects on the way are made if missing."""
    if not names:
        return change(v)
    name, *rest = names
    if isinstance(v.dtype, T.ArrayType):
        if not name.isdigit():
            raise SpecError(f"field {name!r} can't be set in an array")
        at = int(name)
        new = set_path(values.field(v, name), rest, change)
        to = values.common_type(v.dtype.elementType, new.dtype)
        old = F.coalesce(v.col, F.array().cast(v.dtype))
        inner = v.dtype.elementType
        padded = F.transform(F.sequence(F.lit(0), F.greatest(F.size(old) - 1, F.lit(at))), lambda i: F.when(i == at, values.coerce(new, to)).otherwise(values.coerce(Val(F.get(old, i), inner), to)))
        return Val(padded, T.ArrayType(to))
    if isinstance(v.dtype, T.MapType):
        new = set_path(values.field(v, name), rest, change)
        kept = F.map_filter(F.coalesce(v.col, F.create_map().cast(v.dtype)), lambda k, _: k != name)
        return Val(F.map_concat(kept, F.create_map(F.lit(name), values.coerce(new, v.dtype.valueType))), v.dtype)
    if not isinstance(v.dtype, (T.StructType, T.NullType)):
        raise SpecError(f"field {name!r} can't be set in a {v.kind}")
    old = v.dtype.names if isinstance(v.dtype, T.StructType) else []
    parts = {n: values.field(v, n) for n in old}
    parts[name] = set_path(parts.get(name, missing()), rest, change)
    return values.struct(parts)


def drop_path(v: Val, names: list[str]) -> Val | None:
    """The object without a field; None if nothing is left of v itself."""
    name, *rest = names
    if not isinstance(v.dtype, T.StructType) or name not in v.dtype.names:
        return v
    parts = {n: values.field(v, n) for n in v.dtype.names}
    inner = drop_path(parts[name], rest) if rest else None
    if inner is None:
        del parts[name]
    else:
        parts[name] = inner
    if not parts:
        return None
    new = values.struct(parts)
    return Val(F.when(v.col.isNotNull(), new.col), new.dtype)


def tree_of(paths) -> dict:
    """Dotted paths as nested dicts; True marks a leaf."""
    tree: dict = {}
    for p in paths:
        at = tree
        *parents, last = p.split(".")
        for n in parents:
            at = at.setdefault(n, {})
            if at is True:
                break
        else:
            at[last] = True
    return tree


def keep_paths(v: Val, tree: dict) -> Val | None:
    """The object with only the fields of the tree; None if it has none of them."""
    if isinstance(v.dtype, T.ArrayType) and isinstance(v.dtype.elementType, T.StructType):
        inner = v.dtype.elementType
        kept = keep_paths(Val(F.lit(None).cast(inner), inner), tree)
        if kept is None:
            return None
        return Val(F.transform(v.col, lambda x: keep_paths(Val(x, inner), tree).col), T.ArrayType(kept.dtype))
    if not isinstance(v.dtype, T.StructType):
        return None
    parts = {}
    for n, sub in tree.items():
        if n in v.dtype.names:
            f = values.field(v, n)
            kept = f if sub is True else keep_paths(f, sub)
            if kept is not None:
                parts[n] = kept
    if not parts:
        return None
    new = values.struct(parts)
    return Val(F.when(v.col.isNotNull(), new.col), new.dtype)


def to_columns(fields: dict[str, Val]) -> list[Column]:
    """Columns for select; a field without a type becomes a null string, which every sink can hold."""
    return [(v.col.cast("string") if v.dtype == NULL else v.col).alias(n) for n, v in fields.items()]


def hidden(df: DataFrame, names=HIDDEN) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]
