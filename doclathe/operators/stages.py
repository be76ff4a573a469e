"""Pipeline stages: each takes a state and its operand, and returns the next state.  All are lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import geo, values
from doclathe.functions.expression import compile_expression
from doclathe.functions.paths import ORD, SCORE, Scope, drop_path, hidden, keep_paths, set_path, to_columns, tree_of
from doclathe.functions.values import Val, literal
from doclathe.operators.accumulators import ORDERED, compile_accumulator
from doclathe.operators.predicate import compile_filter
from doclathe.operators.projection import _flag
from doclathe.sources.scratch import snapshot


@dataclass
class State:
    """A frame on its way through a pipeline."""

    df: DataFrame
    env: object = None
    #: Whether later stages ask for the order of rows.
    ordered_later: bool = False
    #: The name of the stage after this one.
    next: str | None = None

    @property
    def scope(self) -> Scope:
        return Scope.of(self.df)

    def to(self, df: DataFrame) -> State:
        return replace(self, df=df)

    def select(self, fields: dict[str, Val]) -> State:
        return self.to(self.df.select(*to_columns(fields), *hidden(self.df, (ORD, SCORE))))

    def order(self) -> Column | None:
        """What sorts as the rows come; None if the frame has no order."""
        return F.col(ORD) if ORD in self.df.columns else None


STAGES: dict[str, Callable[[State, object], State]] = {}


def stage(name: str):
    def put(f):
        STAGES[name] = f
        return f

    return put


def asks_for_order(spec: dict) -> bool:
    """Whether a stage's result depends on the order of its input."""
    ((name, operand),) = spec.items()
    if name == "$group":
        return any(isinstance(a, dict) and set(a) & ORDERED for k, a in operand.items() if k != "_id")
    return False


def with_order(df: DataFrame) -> DataFrame:
    """Adds the order of arrival: increasing in the frame's own order, without a shuffle."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


@stage("$match")
def _match(s: State, operand) -> State:
    scope = s.scope
    kept = s.df.filter(compile_filter(operand, scope))
    if scope.score:
        kept = kept.withColumn(SCORE, scope.score[-1])
    return s.to(kept)


def _is_computed(v) -> bool:
    return _flag(v) is None


@stage("$project")
def _project(s: State, operand) -> State:
    if not isinstance(operand, dict) or not operand:
        raise SpecError("$project needs an object")
    scope = s.scope
    flat = dict(_flatten(operand))
    computed = {k: v for k, v in flat.items() if _is_computed(v)}
    flags = {k: _flag(v) for k, v in flat.items() if k not in computed}
    modes = {f for k, f in flags.items() if k != "_id"}
    if len(modes) > 1 or (computed and False in modes):
        raise SpecError("$project can't mix inclusion and exclusion")
    if not computed and (modes == {False} or (not modes and flags == {"_id": False})):
        return _unset(s, [k for k, f in flags.items() if not f])
    tree = tree_of([*(["_id"] if flags.get("_id", True) and "_id" in scope.fields else []), *(k for k, f in flags.items() if f)])
    out: dict[str, Val] = {}
    for n, sub in tree.items():
        if n in scope.fields:
            kept = scope.fields[n] if sub is True else keep_paths(scope.fields[n], sub)
            if kept is not None:
                out[n] = kept
    for k, spec in computed.items():
        v = _meta(s) if spec == {"$meta": "textScore"} else compile_expression(spec, scope)
        first, *rest = k.split(".")
        out[first] = set_path(out.get(first, values.missing()), rest, lambda _, v=v: v)
    return s.select(out)


def _meta(s: State) -> Val:
    return Val(F.col(SCORE), T.DoubleType()) if SCORE in s.df.columns else values.missing()


def _flatten(spec: dict, prefix: str = ""):
    """{a: {b: 1}} as a.b: 1 where all leaves are flags; other objects are expressions."""
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(x.startswith("$") for x in v) and all(_only_flags(x) for x in v.values()):
            yield from _flatten(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def _only_flags(v) -> bool:
    return all(_only_flags(x) for x in v.values()) if isinstance(v, dict) and v else _flag(v) is not None


@stage("$addFields")
def _add_fields(s: State, operand) -> State:
    if not isinstance(operand, dict):
        raise SpecError("$addFields needs an object")
    scope = s.scope
    out = dict(scope.fields)
    for k, spec in operand.items():
        v = _meta(s) if spec == {"$meta": "textScore"} else compile_expression(spec, scope)
        first, *rest = k.split(".")
        out[first] = set_path(out.get(first, values.missing()), rest, lambda _, v=v: v)
    return s.select(out)


STAGES["$set"] = _add_fields


@stage("$unset")
def _unset(s: State, operand) -> State:
    paths = [operand] if isinstance(operand, str) else list(operand)
    out = dict(s.scope.fields)
    for p in paths:
        first, *rest = p.split(".")
        if first in out:
            kept = drop_path(out[first], rest) if rest else None
            if kept is None:
                del out[first]
            else:
                out[first] = kept
    return s.select(out)


@stage("$count")
def _count(s: State, operand) -> State:
    if not isinstance(operand, str) or not operand or operand.startswith("$"):
        raise SpecError("$count needs a field name")
    return s.to(s.df.agg(F.count(F.lit(1)).alias(operand)))


@stage("$replaceRoot")
def _replace_root(s: State, operand) -> State:
    if not isinstance(operand, dict) or "newRoot" not in operand:
        raise SpecError("$replaceRoot needs newRoot")
    return _new_root(s, operand["newRoot"])


@stage("$replaceWith")
def _new_root(s: State, spec) -> State:
    v = compile_expression(spec, s.scope)
    if not isinstance(v.dtype, T.StructType):
        raise SpecError("the new root is not an object")
    sure = Val(F.coalesce(v.col, F.raise_error(F.lit("the new root is not an object")).cast(v.dtype)), v.dtype)
    if not _may_be_null(spec):
        sure = v
    return s.select({n: values.field(sure, n) for n in v.dtype.names})


def _may_be_null(spec) -> bool:
    """Objects that a spec builds are there; those that it only points to may not be."""
    return not (isinstance(spec, dict) and ("$mergeObjects" in spec or not any(k.startswith("$") for k in spec)))


@stage("$sortByCount")
def _sort_by_count(s: State, operand) -> State:
    v = compile_expression(operand, s.scope)
    column = to_columns({"_id": v})[0]
    # Ties: by value, as the order of arrival would cost a second aggregate.
    df = s.df.select(column).groupBy("_id").agg(F.count(F.lit(1)).alias("count"))
    keys = [F.col("count").desc()] + ([F.col("_id").asc_nulls_first()] if v.kind not in ("object", "variant") else [])
    return s.to(df.orderBy(*keys))


@stage("$redact")
def _redact(s: State, operand) -> State:
    scope = s.scope
    whole = values.struct(scope.fields)

    def each_of(dtype: T.StructType):
        def each(e):
            said, kept = walk(Val(e, dtype), scope.inside(Val(e, dtype)))
            return F.when(said == "$$KEEP", e).when(said == "$$DESCEND", kept.col)

        return each

    def walk(v: Val, inner: Scope) -> tuple[Column, Val]:
        """The verdict on an object, and the object with its parts redacted."""
        verdict = compile_expression(operand, inner).col
        parts = {}
        for n in v.dtype.names:
            f = values.field(v, n)
            if isinstance(f.dtype, T.StructType):
                said, kept = walk(f, scope.inside(f))
                parts[n] = Val(F.when(f.col.isNotNull() & (said == "$$KEEP"), f.col).when(f.col.isNotNull() & (said == "$$DESCEND"), kept.col), f.dtype)
            elif isinstance(f.dtype, T.ArrayType) and isinstance(f.dtype.elementType, T.StructType):
                parts[n] = Val(F.filter(F.transform(f.col, each_of(f.dtype.elementType)), lambda e: e.isNotNull()), f.dtype)
            else:
                parts[n] = f
        return verdict, values.struct(parts)

    said, kept = walk(whole, scope)
    rows = s.df.withColumn("_said", said).filter(F.col("_said") != "$$PRUNE")
    out = {n: Val(F.when(F.col("_said") == "$$KEEP", scope.fields[n].col).otherwise(values.field(kept, n).col), scope.fields[n].dtype) for n in scope.fields}
    return s.to(rows.select(*to_columns(out), *hidden(s.df, (ORD, SCORE))))


def _whole(n, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n < 0 or n != int(n):
        raise SpecError(f"{name} needs a number from 0, not {n!r}")
    return int(n)


@stage("$limit")
def _limit(s: State, operand) -> State:
    return s.to(s.df.limit(_whole(operand, "$limit")))


def without_first(df: DataFrame, n: int) -> DataFrame:
    """All rows but the first n, as they come, in that order.

    An offset without a limit would send all rows to one task.  Here the rows are written once with their
    numbers; rows are counted by partition, and what is left begins at one number."""
    at = "_doclathe_at"
    rows = snapshot(df.withColumn(at, F.monotonically_increasing_id()))
    # The number's upper bits are the partition: one small row for each.
    parts = rows.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    first = None
    for p, size in sorted((r["p"], r["n"]) for r in parts):
        if n < size:
            first = (p << 33) + n
            break
        n -= size
    kept = rows.filter(F.col(at) >= first) if first is not None else rows.limit(0)
    return kept.orderBy(at).drop(at)


@stage("$skip")
def _skip(s: State, operand) -> State:
    n = _whole(operand, "$skip")
    if not n or s.next == "$limit" or s.df.isStreaming:
        return s.to(s.df.offset(n))
    return s.to(without_first(s.df, n))


@stage("$unwind")
def _unwind(s: State, operand) -> State:
    spec = {"path": operand} if isinstance(operand, str) else dict(operand)
    path = spec.get("path", "")
    if not path.startswith("$"):
        raise SpecError("$unwind's path starts with $")
    path = path[1:]
    scope = s.scope
    v = scope.get(path)
    keep, index = bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    if v.kind == "null":
        return s if keep else s.to(s.df.filter(F.lit(False)))
    if v.kind != "array":
        raise SpecError(f"$unwind: {path} is not an array")
    # The generator's own two columns come last; a hidden name keeps them from the document's fields.
    split = F.posexplode_outer(v.col) if keep else F.posexplode(v.col)
    df = s.df.select("*", split.alias("_at", "_element"))
    out = dict(scope.fields)
    first, *rest = path.split(".")
    element = Val(F.col("_element"), v.dtype.elementType)
    out[first] = set_path(out[first], rest, lambda _: element) if rest else element
    if index:
        at = Val(F.col("_at").cast("long"), T.LongType())
        first, *rest = index.split(".")
        out[first] = set_path(out.get(first, values.missing()), rest, lambda _: at)
    order = []
    if ORD in s.df.columns:  # elements follow each other within their document's place
        order = [F.struct(F.col(ORD).alias("o"), F.col("_at").alias("i")).alias(ORD)]
    return s.to(df.select(*to_columns(out), *order, *hidden(s.df, (SCORE,))))


@stage("$group")
def _group(s: State, operand) -> State:
    if not isinstance(operand, dict) or "_id" not in operand:
        raise SpecError("$group needs _id")
    scope = s.scope
    key = compile_expression(operand["_id"], scope)
    wanted = {k: a for k, a in operand.items() if k != "_id"}
    order = s.order() if any(isinstance(a, dict) and set(a) & ORDERED for a in wanted.values()) else None
    found = {k: compile_accumulator(a, scope, order) for k, a in wanted.items()}
    if key.kind == "variant":
        key = Val(values.variant_text(key.col), T.StringType())
        return _parsed_key(s.to(_grouped(s, key, operand, wanted, found, order)))
    return s.to(_grouped(s, key, operand, wanted, found, order))


def _parsed_key(s: State) -> State:
    return s.to(s.df.withColumn("_id", F.parse_json("_id")))


def _grouped(s: State, key: Val, operand, wanted: dict, found: dict[str, Val], order) -> DataFrame:
    # Sets are made distinct before any group is gathered: each value of a group once, with its first place.
    sets = {k: compile_expression(a["$addToSet"], s.scope) for k, a in wanted.items() if isinstance(a, dict) and list(a) == ["$addToSet"]}
    sets = {k: v for k, v in sets.items() if v.kind not in ("null", "variant", "other") and not isinstance(v.dtype, T.MapType)}
    found = {k: v for k, v in found.items() if k not in sets}
    if not sets:
        return _aggregated(s, key, operand, found)
    df = _aggregated(s, key, operand, found)
    by = key.col if key.kind != "null" and operand["_id"] is not None else F.lit(None).cast("string")
    for k, v in sets.items():
        each = s.df.select(by.alias("_key"), v.col.alias("_value"), order.alias("_at")).groupBy("_key", "_value").agg(F.min("_at").alias("_at"))
        rows = each.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_rows"))
        rows = rows.select("_key", F.transform("_rows", lambda r: r["_value"]).alias(k))
        df = df.join(rows, df["_id"].eqNullSafe(rows["_key"]), "left").drop("_key")
    return df.select("_id", *(F.col(f"`{k}`") for k in wanted), *(F.col(c) for c in df.columns if c == ORD))


def _aggregated(s: State, key: Val, operand, found: dict[str, Val]) -> DataFrame:
    aggregates = [v.col.alias(k) for k, v in found.items()]
    if s.ordered_later and ORD in s.df.columns:
        aggregates.append(F.min(ORD).alias(ORD))
    if key.kind == "null" or operand["_id"] is None:
        df = s.df.agg(*aggregates, F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")
        return df.select(F.lit(None).cast("string").alias("_id"), *(F.col(f"`{c}`") for c in df.columns))
    return s.df.groupBy(key.col.alias("_id")).agg(*aggregates) if aggregates else s.df.select(key.col.alias("_id")).distinct()


@stage("$sample")
def _sample(s: State, operand) -> State:
    if not isinstance(operand, dict) or "size" not in operand:
        raise SpecError("$sample needs size")
    seed = operand.get("seed")
    return s.to(s.df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(_whole(operand["size"], "$sample")))


def sort_columns(spec, scope: Scope) -> list[Column]:
    if not isinstance(spec, dict) or not spec:
        raise SpecError("a sort needs an object of 1 and -1")
    out = []
    for path, d in spec.items():
        if isinstance(d, dict) and d.get("$meta") == "textScore":
            out.append(F.col(SCORE).desc_nulls_last())
            continue
        if isinstance(d, bool) or d not in (1, -1):
            raise SpecError(f"a sort's direction is 1 or -1, not {d!r}")
        v = scope.get(path)
        if v.kind == "null":
            continue
        c = values.variant_key(v.col) if v.kind == "variant" else v.col
        out.append(c.asc_nulls_first() if d == 1 else c.desc_nulls_last())
    return out


@stage("$sort")
def _sort(s: State, operand) -> State:
    keys = sort_columns(operand, s.scope)
    ties = [F.col(ORD).asc()] if ORD in s.df.columns else []
    if not keys:
        return s
    df = s.df.orderBy(*keys, *ties)
    # Sorted partitions follow each other, so numbers given now tell the sorted order to later stages.
    return s.to(df.withColumn(ORD, F.monotonically_increasing_id()) if s.ordered_later else df)


# Names that a point's field may have, in the order in which they are tried.
LOCATIONS = ("location", "loc", "geometry", "coordinates", "pos", "position")


@stage("$geoNear")
def _geo_near(s: State, operand) -> State:
    if not isinstance(operand, dict) or "near" not in operand:
        raise SpecError("$geoNear needs near")
    if not isinstance(operand.get("distanceField"), str):
        raise SpecError("$geoNear needs distanceField")
    at = geo.literal_point(operand["near"])
    scope = s.scope
    df = s.df
    if operand.get("query"):
        df = df.filter(compile_filter(operand["query"], scope))
    key = operand.get("key") or next((n for n in LOCATIONS if n in scope.fields), None)
    if key is None:
        raise SpecError("$geoNear can't tell the location field; give key")
    p = geo.point_of(scope.get(key))
    if p is None:
        return s.to(df.filter(F.lit(False)))
    d = (geo.radians if operand.get("spherical") else geo.planar)(*p, at) * float(operand.get("distanceMultiplier", 1))
    df = df.withColumn("_distance", d).filter("_distance is not null")
    if operand.get("maxDistance") is not None:
        df = df.filter(F.col("_distance") <= float(operand["maxDistance"]))
    if operand.get("minDistance") is not None:
        df = df.filter(F.col("_distance") >= float(operand["minDistance"]))
    out = dict(scope.fields)
    first, *rest = operand["distanceField"].split(".")
    out[first] = set_path(out.get(first, values.missing()), rest, lambda _: Val(F.col("_distance"), T.DoubleType()))
    df = df.orderBy("_distance", *([F.col(ORD)] if ORD in df.columns else []))
    df = df.select(*to_columns(out), *hidden(s.df, (ORD, SCORE)))
    return s.to(df.withColumn(ORD, F.monotonically_increasing_id()) if s.ordered_later else df)


@stage("$lookup")
def _lookup(s: State, operand) -> State:
    names = ("localField", "foreignField", "as")
    if not isinstance(operand, dict) or "from" not in operand or any(not isinstance(operand.get(n), str) for n in names):
        raise SpecError("$lookup needs from, localField, foreignField and as")
    local_path, foreign_path, into = (operand[n] for n in names)
    foreign = with_order(s.env.resolve(operand["from"]))
    right = Scope.of(foreign)
    document = values.struct(right.fields)
    key, local = right.get(foreign_path), s.scope.get(local_path)
    listed = local.kind == "array"
    one = Val(local.col, local.dtype.elementType) if listed else local
    into_first, *into_rest = into.split(".")
    out = dict(s.scope.fields)
    shape = T.ArrayType(document.dtype)

    def put(found: Column) -> dict[str, Val]:
        found = Val(F.coalesce(found, F.array().cast(shape)), shape)
        return out | {into_first: set_path(out.get(into_first, values.missing()), into_rest, lambda _: found)}

    never = one.kind != "null" and key.kind != "null" and not values.comparable(one, key)
    if never and not (one.kind == key.kind):
        return s.select(put(F.lit(None).cast(shape)))
    to = values.common_type(one.dtype, key.dtype)
    to = T.StringType() if isinstance(to, T.NullType) else to
    docs = foreign.select(values.coerce(key, to).alias("_fk"), F.col(ORD).alias("_fo"), document.col.alias("_doc"))
    # Foreign rows without a key are gathered only if a document asks for them.
    asks = s.df.filter(F.exists(local.col, lambda x: x.isNull()) | local.col.isNull() if listed else local.col.isNull())
    asks = asks.limit(1).select(F.lit(True).alias("_asked"))
    docs = docs.filter("_fk is not null").unionByName(docs.filter("_fk is null").crossJoin(F.broadcast(asks)).drop("_asked"))
    if not listed:
        # Foreign rows are gathered once a key, so local rows are never multiplied.
        rows = F.array_sort(F.collect_list(F.struct("_fo", "_doc")))
        grouped = docs.groupBy("_fk").agg(F.transform(rows, lambda r: r["_doc"]).alias("_found"))
        df = s.df.withColumn("_lk", values.coerce(local, to))
        joined = df.join(grouped, df["_lk"].eqNullSafe(grouped["_fk"]), "left")
        return s.to(joined.select(*to_columns(put(F.col("_found"))), *hidden(s.df, (ORD, SCORE))))
    # Each different array of keys once: its keys, their foreign rows, and back to all documents that hold it.
    # (By the array's value: row numbers would not be the same in both branches of the plan.)
    # A missing array is one missing key.
    df = s.df.withColumn("_lk", F.when(local.col.isNull(), F.array(F.lit(None).cast(to))).otherwise(F.array_distinct(values.coerce(local, T.ArrayType(to)))))
    pairs = df.select("_lk").distinct().select("_lk", F.explode("_lk").alias("_key"))
    hits = pairs.join(docs, pairs["_key"].eqNullSafe(docs["_fk"])).groupBy("_lk").agg(F.array_sort(F.collect_list(F.struct("_fo", "_doc"))).alias("_rows"))
    joined = df.join(hits, "_lk", "left")
    return s.to(joined.select(*to_columns(put(F.transform(F.col("_rows"), lambda r: r["_doc"]))), *hidden(s.df, (ORD, SCORE))))


@stage("$out")
def _out(s: State, operand) -> State:
    target = operand if operand is not None else getattr(s.env, "out", None)
    if target is None:
        raise SpecError("$out needs a target")
    s.env.write_out(target, s.df.drop(*[c for c in (ORD, SCORE) if c in s.df.columns]))
    return s


@stage("$indexStats")
def _index_stats(s: State, operand) -> State:
    stats = list(getattr(s.env, "index_stats", None) or [])
    spark = s.df.sparkSession
    schema = "name string, key map<string,int>, accesses struct<ops:long>"
    return s.to(spark.createDataFrame([(x["name"], x["key"], (x["accesses"]["ops"],)) for x in stats], schema))
