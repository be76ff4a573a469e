"""Identifiers of 12 bytes: seconds, a random part of the process, a counter.  Stored as 24 hex digits."""

from __future__ import annotations

import datetime
import itertools
import os
import re
import secrets
import time

_HEX = re.compile(r"[0-9a-fA-F]{24}")


class ObjectId:
    _process = os.urandom(5).hex()
    _count = itertools.count(secrets.randbelow(1 << 24))

    def __init__(self, value=None):
        if value is None:
            value = f"{int(time.time()):08x}{self._process}{next(self._count) & 0xFFFFFF:06x}"
        self._hex = str(value).lower()
        if not self.is_valid(self._hex):
            raise ValueError(f"not an ObjectId: {value!r}")

    @staticmethod
    def is_valid(value) -> bool:
        return bool(_HEX.fullmatch(str(value)))

    @classmethod
    def from_time(cls, seconds: int) -> ObjectId:
        return cls(f"{seconds:08x}" + "0" * 16)

    @property
    def generation_time(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(int(self._hex[:8], 16), datetime.timezone.utc)

    def __str__(self) -> str:
        return self._hex

    def __repr__(self) -> str:
        return f"ObjectId({self._hex!r})"

    def __eq__(self, other) -> bool:
        return str(other).lower() == self._hex

    def __hash__(self) -> int:
        return hash(self._hex)
