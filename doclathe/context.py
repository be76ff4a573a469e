"""Settings, and the errors that specs raise at compile time."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


class SpecError(ValueError):
    """A filter, pipeline, expression or update that can't be compiled."""


@dataclass(frozen=True)
class Settings:
    """Options of a session.  id_projection keeps ``_id`` in inclusions by default; text_search is
    ``lightweight``, ``stemming`` or ``exact``; auto_id gives inserted documents an ``_id``; where_timeout is
    accepted and not used, as predicates run inside Spark tasks."""

    id_projection: bool = True
    text_search: str = "lightweight"
    auto_id: bool = False
    where_timeout: int = 1000


_settings = Settings()


def settings() -> Settings:
    return _settings


def configure(**options) -> Settings:
    global _settings
    unknown = set(options) - {f.name for f in fields(Settings)}
    if unknown:
        raise SpecError(f"unknown settings: {sorted(unknown)}")
    if options.get("text_search", "lightweight") not in ("lightweight", "stemming", "exact"):
        raise SpecError("text_search must be lightweight, stemming or exact")
    _settings = replace(_settings, **options)
    return _settings


def reset() -> Settings:
    global _settings
    _settings = Settings()
    return _settings
