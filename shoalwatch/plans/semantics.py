"""What the columns of a dataset mean, from a small sample."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.functions.sampling import seeded_sample

THRESHOLD, SAMPLE = 0.8, 100
# fixed values: zone names and offsets at the end of a time, and clock formats
ZONE_NAME, ZONE_OFFSET = r" [A-Z]{3,4}$", r"[+-]\d{2}:\d{2}$"
_ZONE = r"( [A-Z]{3,4}|[+-]\d{2}:\d{2})$"
CLOCKS = [("HH:mm:ss", r"^\d{2}:\d{2}:\d{2}$"), ("HH:mm", r"^\d{2}:\d{2}$"), ("hh:mm:ss a", r"^\d{2}:\d{2}:\d{2} [AaPp][Mm]$"), ("hh:mm a", r"^\d{2}:\d{2} [AaPp][Mm]$")]
URL, IDENTIFIER = r"^https?://", r"^@?[A-Za-z0-9_.:-]+$"
EPOCH_FROM, EPOCH_TO = "2000-01-01", "2100-01-01"


@dataclass(frozen=True)
class Semantic:
    name: str
    type: str


def strip_zone(c: Column) -> Column:
    """Cut a trailing zone name, then a trailing offset; nothing is converted."""
    return F.regexp_replace(F.regexp_replace(c, ZONE_NAME, ""), ZONE_OFFSET, "")


def parse_datetime(c: Column) -> Column:
    return F.trim(strip_zone(c)).try_cast("timestamp_ntz")


def parse_time(c: Column, clock: str) -> Column:
    """``HH:mm:ss`` of one clock format; null where it doesn't fit."""
    shape = dict(CLOCKS)[clock]
    t = F.trim(c)
    parsed = F.try_to_timestamp(F.when(t.rlike(shape), F.concat(F.lit("2000-01-01 "), F.upper(t))), F.lit(f"yyyy-MM-dd {clock}"))
    return F.date_format(parsed, "HH:mm:ss")


def parse_epoch(c: Column, per_second: int) -> Column:
    """Wall-clock UTC of seconds or milliseconds between 2000 and 2100."""
    at = F.timestamp_micros((c.cast("double") * (1_000_000 // per_second)).cast("long")).cast("timestamp_ntz")
    return F.when((at > F.lit(EPOCH_FROM).cast("timestamp_ntz")) & (at < F.lit(EPOCH_TO).cast("timestamp_ntz")), at)


def _candidates(kind: T.DataType) -> list[tuple[Semantic, callable]]:
    text = isinstance(kind, T.StringType)
    number = isinstance(kind, T.NumericType)
    out: list = []
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out.append((Semantic("native_datetime", "datetime"), lambda c: c.cast("timestamp_ntz")))
    if isinstance(kind, T.DateType):
        out.append((Semantic("native_date", "datetime"), lambda c: c.cast("timestamp_ntz")))
    if text:
        for clock, _ in CLOCKS:
            out.append((Semantic(f"time:{clock}", "time"), lambda c, k=clock: parse_time(c, k)))
        out.append((Semantic("datetime", "datetime"), parse_datetime))
    if number:
        out.append((Semantic("epoch_seconds", "datetime"), lambda c: parse_epoch(c, 1)))
        out.append((Semantic("epoch_milliseconds", "datetime"), lambda c: parse_epoch(c, 1000)))
    if text:
        out.append((Semantic("url", "url"), lambda c: F.when(F.trim(c).rlike(URL), F.trim(c))))
        out.append((Semantic("identifier", "identifier"), lambda c: F.when(F.trim(c).rlike(IDENTIFIER), F.trim(c))))
    return out


def _fallback(kind: T.DataType) -> Semantic:
    if isinstance(kind, T.BooleanType):
        return Semantic("boolean", "boolean")
    if isinstance(kind, T.IntegralType):
        return Semantic("integer", "integer")
    if isinstance(kind, T.NumericType):
        return Semantic("float", "float")
    return Semantic("free_text", "text")


def infer(df: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, seed: int = 0) -> dict[str, Semantic]:
    """Semantic type of each column: the first whose share of valid values exceeds ``threshold``.

    Of the clock formats, the first that any value has is the column's, and
    the others aren't tried. All checks of all columns are one aggregate over
    ``sample`` rows, chosen by ``seed`` among all distinct ones. Nulls count
    as invalid, so columns without values, and empty tables, are free text
    (or the number or boolean they hold).
    """
    rows = seeded_sample(df, sample, seed)
    checks, plan = [], {}
    for f in df.schema:
        plan[f.name] = _candidates(f.dataType)
        for i, (_, parse) in enumerate(plan[f.name]):
            checks.append(F.coalesce(F.avg(parse(F.col(f"`{f.name}`")).isNotNull().cast("int")), F.lit(0.0)).alias(f"{f.name}\0{i}"))
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    zones = [F.collect_set(F.regexp_extract(F.col(f"`{c}`"), _ZONE, 1)).alias(f"{c}\0zones") for c in texts]
    shares = rows.agg(*checks, *zones).first().asDict() if checks else {}
    out = {}
    for f in df.schema:
        found = [(s, shares[f"{f.name}\0{i}"]) for i, (s, _) in enumerate(plan[f.name])]
        clock = next((s for s, share in found if s.type == "time" and share > 0), None)
        fits = (s for s, share in found if share > threshold and (s.type != "time" or s == clock))
        out[f.name] = next(fits, _fallback(f.dataType))
        if out[f.name].name == "datetime":
            seen = sorted(z for z in shares[f"{f.name}\0zones"] if z)
            if len(seen) > 1:
                warnings.warn(f"column {f.name} mixes time zones {seen}; they are dropped, not converted", stacklevel=2)
    return out


def convert(c: Column, semantic: Semantic) -> Column:
    """The column as its semantic type; null where it doesn't fit."""
    name = semantic.name
    if name.startswith("time:"):
        return parse_time(c, name[5:])
    simple = {
        "native_datetime": lambda: c.cast("timestamp_ntz"),
        "native_date": lambda: c.cast("timestamp_ntz"),
        "datetime": lambda: parse_datetime(c),
        "epoch_seconds": lambda: parse_epoch(c, 1),
        "epoch_milliseconds": lambda: parse_epoch(c, 1000),
        "url": lambda: F.trim(c.cast("string")),
        "identifier": lambda: F.trim(c.cast("string")),
    }
    return simple[name]() if name in simple else c


def prepare(df: DataFrame, mapping: dict[str, str], semantics: dict[str, Semantic]) -> DataFrame:
    """Select, convert and rename the mapped columns (input name to user column)."""
    return df.select([convert(F.col(f"`{column}`"), semantics[column]).alias(name) for name, column in mapping.items()])


def summarize(df: DataFrame, semantics: dict[str, Semantic]) -> list[dict[str, str]]:
    """Name, physical type, first value of at most 25 characters, meaning."""
    firsts = df.limit(SAMPLE).agg(*[F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True).alias(c) for c in df.columns]).first()
    return [{"column": c, "type": t, "example": (firsts[c] or "")[:25], "semantic": semantics[c].type} for c, t in df.dtypes]
