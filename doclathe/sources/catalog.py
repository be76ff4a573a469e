"""Named collections of a process, and what stages need to find others."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclathe.context import SpecError

_collections: dict[str, object] = {}


def get(name: str):
    return _collections.get(name)


def put(name: str, collection) -> None:
    _collections[name] = collection


def has(name: str) -> bool:
    return name in _collections


def drop(name: str) -> bool:
    return _collections.pop(name, None) is not None


def names() -> list[str]:
    return sorted(_collections)


def rename(old: str, new: str) -> None:
    if old not in _collections:
        raise SpecError(f"no collection {old!r}")
    _collections[new] = _collections.pop(old)


def reset() -> None:
    _collections.clear()


class Environment:
    """What a pipeline may refer to: names, collections and frames, and the target of $out."""

    def __init__(self, index_stats=None, out=None):
        self.index_stats, self.out = index_stats, out

    def resolve(self, ref) -> DataFrame:
        if isinstance(ref, DataFrame):
            return ref
        if isinstance(ref, str):
            if not has(ref):
                raise SpecError(f"unknown collection {ref!r}")
            ref = get(ref)
        if hasattr(ref, "frame"):
            return ref.frame
        raise SpecError(f"not a collection: {ref!r}")

    def write_out(self, target, df: DataFrame) -> None:
        """Replace a named collection (made if there is none), a collection, or a path's files."""
        from doclathe.collection import Collection

        if isinstance(target, str) and "/" in target:
            df.write.mode("overwrite").parquet(target)
        elif isinstance(target, str):
            if has(target):
                get(target).replace(df)
            else:
                put(target, Collection(df))
        elif isinstance(target, Collection):
            target.replace(df)
        else:
            raise SpecError("$out needs a name, a path or a collection")
