"""Projections of find: inclusion, exclusion, $slice, $elemMatch, the positional element and $meta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.context import SpecError, settings
from doclathe.functions.paths import ORD, SCORE, Scope, drop_path, hidden, keep_paths, to_columns, tree_of
from doclathe.functions.values import Val, missing
from doclathe.operators.predicate import element_filter

OPERATORS = ("$slice", "$elemMatch", "$meta")


def _flag(v) -> bool | None:
    """True to include, False to exclude, None for neither."""
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) and v in (0, 1):
        return bool(v)
    return None


def check(spec: dict) -> bool | None:
    """Whether a projection includes (True), excludes (False) or does neither (None)."""
    modes = set()
    for k, v in spec.items():
        if isinstance(v, dict):
            ops = [o for o in v if o.startswith("$")]
            if not ops or any(o not in OPERATORS for o in ops):
                raise SpecError(f"unknown projection of {k}: {v}")
            if "$elemMatch" in v:
                modes.add(True)
            continue
        flag = _flag(v)
        if flag is None:
            raise SpecError(f"a projection is 0, 1, true or false, not {v!r}")
        if k != "_id" or not settings().id_projection:
            modes.add(flag)
    if len(modes) > 1:
        raise SpecError("a projection can't mix inclusion and exclusion")
    return modes.pop() if modes else None


def slice_of(v: Val, spec) -> Val:
    if v.kind != "array":
        return v
    size = F.size(v.col)
    if isinstance(spec, (list, tuple)):
        skip, n = spec
        if n <= 0:
            raise SpecError("$slice needs a positive count after a skip")
        start = F.lit(skip) if skip >= 0 else F.greatest(size + skip, F.lit(0))
    elif spec >= 0:
        start, n = F.lit(0), spec
    else:
        start, n = F.greatest(size + spec, F.lit(0)), -spec
    return Val(F.slice(v.col, start + 1, F.lit(n)), v.dtype)


def first_match(v: Val, cond, scope: Scope) -> Val:
    """The first element that matches, alone in an array; null if there is none."""
    if v.kind != "array":
        return missing()
    of = v.dtype.elementType
    found = F.slice(F.filter(v.col, lambda x: element_filter(Val(x, of), cond, scope)), 1, 1)
    return Val(F.when(F.size(found) > 0, found), v.dtype)


def element_condition(query: dict, path: str):
    """What a query says about the elements of an array: the condition on it, or on fields below it."""
    if not isinstance(query, dict):
        return None
    if path in query:
        cond = query[path]
        return cond["$elemMatch"] if isinstance(cond, dict) and "$elemMatch" in cond else cond
    below = {k[len(path) + 1 :]: c for k, c in query.items() if k.startswith(path + ".")}
    if below:
        return below
    for k in ("$and", "$or"):
        for q in query.get(k, []):
            if (c := element_condition(q, path)) is not None:
                return c
    return None


def project(df: DataFrame, spec: dict | None, query: dict | None = None) -> DataFrame:
    """Hidden columns stay."""
    if not spec:
        return df
    mode = check(spec)
    scope = Scope.of(df)
    fields = dict(scope.fields)
    computed: dict[str, Val] = {}
    include, exclude = [], []
    for k, v in spec.items():
        if isinstance(v, dict):
            if "$slice" in v:
                computed[k] = slice_of(scope.get(k), v["$slice"])
                if mode is True:
                    include.append(k)
            elif "$elemMatch" in v:
                computed[k] = first_match(scope.get(k), v["$elemMatch"], scope)
                include.append(k)
            else:
                if v["$meta"] != "textScore":
                    raise SpecError("only textScore is known to $meta")
                computed[k] = Val(F.col(SCORE) if SCORE in df.columns else F.lit(None).cast("double"), df.schema[SCORE].dataType if SCORE in df.columns else missing().dtype)
                if mode is True:
                    include.append(k)
        elif k.endswith(".$"):
            k = k[:-2]
            computed[k] = first_match(scope.get(k), element_condition(query or {}, k), scope)
            include.append(k)
        elif _flag(v):
            include.append(k)
        elif k != "_id" or not _flag(v):
            exclude.append(k)
    for k, v in computed.items():
        if "." in k:
            raise SpecError(f"{k}: a projection operator needs a top-level field")
        fields[k] = v
    if mode is True:
        if "_id" not in spec and settings().id_projection:
            include.insert(0, "_id")
        tree = tree_of(include)
        out = {}
        for n, v in fields.items():
            if n in tree:
                kept = v if tree[n] is True else keep_paths(v, tree[n])
                if kept is not None:
                    out[n] = kept
        if "_id" in exclude:
            out.pop("_id", None)
    else:
        out = fields
        for p in exclude:
            first, *rest = p.split(".")
            if first in out:
                kept = drop_path(out[first], rest) if rest else None
                if kept is None:
                    del out[first]
                else:
                    out[first] = kept
    return df.select(*to_columns(out), *hidden(df, (ORD, SCORE)))
