"""Pipelines: stages validated, then folded over a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclathe.context import SpecError
from doclathe.functions.paths import HIDDEN, ORD
from doclathe.operators.stages import STAGES, State, asks_for_order, with_order
from doclathe.sources.catalog import Environment

#: Stages that need all rows or their order, which a stream never has.
NOT_STREAMING = {"$sort", "$skip", "$limit", "$sample", "$sortByCount", "$geoNear", "$out", "$lookup", "$indexStats"}


def validate(stages) -> list[tuple[str, object]]:
    if not isinstance(stages, (list, tuple)):
        stages = [stages]
    out = []
    for i, s in enumerate(stages):
        if not isinstance(s, dict) or len(s) != 1:
            raise SpecError(f"stage {i} has one operator, not {s!r}")
        ((name, operand),) = s.items()
        if name not in STAGES:
            raise SpecError(f"unknown stage {name}")
        if name == "$out" and i != len(stages) - 1:
            raise SpecError("$out comes last")
        out.append((name, operand))
    return out


def aggregate(df: DataFrame, stages, env: Environment | None = None, keep_hidden: bool = False) -> DataFrame:
    """The result of a pipeline: one plan, not yet run (but for the target of $out)."""
    todo = validate(stages)
    wants = [asks_for_order({n: o}) for n, o in todo]
    if df.isStreaming:
        for (name, _), w in zip(todo, wants):
            if name in NOT_STREAMING or w:
                raise SpecError(f"{name} needs an order or all rows, which a stream has not")
    elif any(wants):
        df = with_order(df)
    state = State(df, env or Environment())
    for i, (name, operand) in enumerate(todo):
        state.ordered_later = any(wants[i + 1 :])
        state.next = todo[i + 1][0] if i + 1 < len(todo) else None
        state = STAGES[name](state, operand)
        if state.ordered_later and ORD not in state.df.columns:
            state.df = with_order(state.df)
    return state.df if keep_hidden else state.df.drop(*[c for c in HIDDEN if c in state.df.columns])
