"""Column typing and scalar expressions used across features."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_LISTS = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def epoch_ns(c: Column) -> Column:
    """Nanoseconds since 1970 as a double; null stays null."""
    return F.unix_micros(c.cast("timestamp")).cast("double") * 1000.0


def typed_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Numbers and times as doubles first, then booleans and strings as strings; lists are left out.

    The schema alone decides, so no row is read.  Returns the frame and the names of its categorical columns.
    """
    numbers, names = [], []
    for f in df.schema.fields:
        if f.name in drop or isinstance(f.dataType, _LISTS):
            continue
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, _TIMES):
            numbers.append(epoch_ns(c).alias(f.name))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            names.append(f.name)
        else:
            numbers.append(F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f.name))
    return df.select(*numbers, *[F.col(quoted(n)).cast("string").alias(n) for n in names]), names


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def calendar(c: Column, prefix: str = "") -> list[Column]:
    """Year, month, day and weekday (Monday = 0) as doubles."""
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": F.weekday(c)}
    return [v.cast("double").alias(prefix + k) for k, v in parts.items()]


def cyclic(c: Column, prefix: str = "") -> list[Column]:
    """Sine and cosine of month over 12, weekday over 7 and day of year over 365."""
    out = []
    for name, value, period in (("month", F.month(c), 12.0), ("dow", F.weekday(c), 7.0), ("doy", F.dayofyear(c), 365.0)):
        turn = F.lit(2.0) * F.pi() * value.cast("double") / period
        out += [F.sin(turn).alias(f"{prefix}{name}_sin"), F.cos(turn).alias(f"{prefix}{name}_cos")]
    return out


def sanitized(name: str) -> str:
    return re.sub("_+", "_", name.replace("(", "_").replace(")", "").replace(".", "_"))


def temporal_diff(df: DataFrame, cutoff: str, marker: str = "_epochtime") -> DataFrame:
    """Columns of epoch times become time until the cutoff, named ``..._diff``; their standard deviations go."""
    out = []
    for name in df.columns:
        if marker in name and name != cutoff:
            if "std" not in name.lower():
                out.append((epoch_ns(F.col(quoted(cutoff))) - F.col(quoted(name))).alias(sanitized(name) + "_diff"))
        else:
            out.append(F.col(quoted(name)))
    return df.select(*out)


def age_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(F.least(c, high), low)


def int60(*parts: Column | str | int) -> Column:
    """A whole number below 2 ** 60 from the first 15 hex digits of an MD5 over the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def unit_key(*parts: Column | str | int) -> Column:
    """A reproducible number strictly between 0 and 1."""
    return (int60(*parts).cast("double") + 1.0) / (2.0**60 + 1.0)


def interval_text(step: timedelta) -> str:
    """A time step as an interval literal that both SQL dialects take: whole days where it can, seconds else."""
    seconds = step.days * 86400 + step.seconds
    if step.microseconds:
        raise ValueError("steps are whole seconds")
    return f"{step.days} days" if step.seconds == 0 else f"{seconds} seconds"
