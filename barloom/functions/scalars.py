"""Row-wise expressions. Missing is null throughout; NaN and infinities are turned into null on entry."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text to double; what doesn't parse, NaN and infinities become null."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def imbalance(a: str | Column, b: str | Column, eps: float = EPS) -> Column:
    """(a - b) / (a + b + eps)."""
    return (col(a) - col(b)) / (col(a) + col(b) + F.lit(eps))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave null alone; least and greatest would skip it."""
    x = col(c)
    y = x if high is None else F.least(x, F.lit(high))
    y = y if low is None else F.greatest(y, F.lit(low))
    return F.when(x.isNotNull(), y)


def decoded(c: str | Column, sentinel: float = -1.0) -> Column:
    """Null for the sentinel that marks a missing sample."""
    return F.nullif(col(c), F.lit(sentinel))


def direction(delta: str | Column, threshold: float) -> Column:
    """1, -1 or 0 by a threshold on either side; null falls to 0."""
    d = col(delta)
    return F.when(d > threshold, 1).when(d < -threshold, -1).otherwise(0)


def ratio(a: Column, b: Column, guard: float = 1e-6) -> Column:
    """a / b, or 0 where b isn't above the guard."""
    return F.when(b > guard, a / b).otherwise(F.lit(0.0))


def filled_in_era(c: str | Column, marker: str | Column, value: float = 0.0) -> Column:
    """Fills nulls only where the era's marker is there."""
    return F.when(col(marker).isNotNull(), F.coalesce(col(c), F.lit(value))).otherwise(col(c))


def cyclic(part: Column, period: float) -> tuple[Column, Column]:
    angle = part * F.lit(2 * pi / period)
    return F.sin(angle), F.cos(angle)


def time_features(ts: str | Column) -> dict[str, Column]:
    """Sine and cosine of hour, minute and weekday (Monday 0) of epoch seconds, UTC."""
    t = F.timestamp_seconds(col(ts))
    out = {}
    for name, part, period in (("hour", F.hour(t), 24), ("minute", F.minute(t), 60), ("dow", F.weekday(t), 7)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part, period)
    return out


def to_next(ts: str | Column, every: int) -> Column:
    """Seconds to the next multiple of ``every``; a full period at the multiple itself."""
    return F.lit(every) - F.pmod(col(ts), F.lit(every))


def bucket(ts: str | Column, width: int) -> Column:
    """Start of the tumbling window of epoch seconds."""
    return (F.floor(col(ts) / F.lit(width)) * width).cast("long")


def hashed(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts, alike in any engine."""
    text = F.concat_ws("-", *[col(x).cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
