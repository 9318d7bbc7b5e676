"""Analysis interfaces: semantic types, columns, parameters, outputs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: the semantic types and the Spark types that hold them
SEMANTIC_TYPES = {
    "text": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "identifier": T.StringType(),
    "url": T.StringType(),
    "time": T.StringType(),
}
_SHORT = {"year": "y", "month": "mo", "week": "w", "day": "d", "hour": "h", "minute": "m", "second": "s"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    human_name: str | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class TimeBin:
    unit: str
    amount: int = 1

    def __post_init__(self):
        if self.unit not in _SHORT:
            raise ValueError(f"unknown unit {self.unit!r}")

    @property
    def spec(self) -> str:
        return f"{self.amount}{_SHORT[self.unit]}"

    @property
    def text(self) -> str:
        return f"{self.amount} {self.unit}{'s' if self.amount != 1 else ''}"


@dataclass(frozen=True)
class Param:
    """An integer between two bounds, or a time bin if it has none."""

    id: str
    default: Any = None
    least: int | None = None
    most: int | None = None
    backfill: Any = None

    def check(self, value: Any) -> Any:
        if self.least is None:
            if not isinstance(value, TimeBin) or not 1 <= value.amount <= 1000:
                raise ValueError(f"{self.id} is a time bin of 1 to 1000 units")
        elif not self.least <= value <= self.most:
            raise ValueError(f"{self.id} goes from {self.least} to {self.most}")
        return value


@dataclass(frozen=True)
class Output:
    id: str
    columns: tuple[Column, ...]
    internal: bool = False

    def human_names(self) -> dict[str, str]:
        return {c.name: c.human_name for c in self.columns if c.human_name}

    def check(self, df: DataFrame) -> DataFrame:
        if missing := [c.name for c in self.columns if c.name not in df.columns]:
            raise ValueError(f"output {self.id} lacks {missing}")
        return df


@dataclass(frozen=True)
class Interface:
    id: str
    name: str
    version: str
    inputs: tuple[Column, ...] = ()
    params: tuple[Param, ...] = ()
    outputs: tuple[Output, ...] = ()
    distributed: bool = False


def resolve_params(interface: Interface, given: dict[str, Any], computed: dict[str, Any] | None = None) -> dict[str, Any]:
    """Static defaults, then computed ones (None unsets), then given values.

    A parameter that is absent takes its back-fill; a stored 0 stays 0.
    """
    values = {p.id: p.default for p in interface.params} | (computed or {}) | given
    out = {}
    for p in interface.params:
        value = values.get(p.id)
        value = p.backfill if value is None else value
        if value is None:
            raise ValueError(f"parameter {p.id} has no value")
        out[p.id] = p.check(value)
    return out
