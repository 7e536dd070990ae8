"""Rolling, shifted and ranked expressions over a window specification.

Row rollers count rows; a value is given once enough non-null ones are in the frame. Time rollers take
integer epoch seconds and are left-open, (t - T, t], so their range starts T - 1 seconds back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import clip, col


def along(*keys: str, by: str | list = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([by] if isinstance(by, str) else by))


def gated(f: Callable[[Column], Column], c: str | Column, frame: WindowSpec, least: int) -> Column:
    x = col(c)
    return F.when(F.count(x).over(frame) >= least, f(x).over(frame))


def rolling(c: str | Column, n: int, least: int, w: WindowSpec, f: Callable[[Column], Column] = F.avg) -> Column:
    """f over the last n rows, null below ``least`` values."""
    return gated(f, c, w.rowsBetween(-(n - 1), 0), least)


def rolling_time(c: str | Column, seconds: int, least: int, w: WindowSpec, f: Callable[[Column], Column] = F.avg) -> Column:
    """f over (t - seconds, t]; w orders by integer epoch seconds."""
    return gated(f, c, w.rangeBetween(-(seconds - 1), 0), least)


def time_z(c: str | Column, seconds: int, least: int, w: WindowSpec, most: float = 8.0) -> Column:
    """Distance from the rolling mean in rolling deviations, clipped; null where the deviation is 0."""
    mean, std = rolling_time(c, seconds, least, w), rolling_time(c, seconds, least, w, F.stddev_samp)
    return clip(F.when(std > 0, (col(c) - mean) / std), -most, most)


def time_ratio(c: str | Column, seconds: int, least: int, w: WindowSpec, most: float = 10.0) -> Column:
    mean = rolling_time(c, seconds, least, w)
    return clip(F.when(mean != 0, col(c) / mean), 0.0, most)


def quantile(c: str | Column, q: float, n: int, least: int, w: WindowSpec) -> Column:
    return rolling(c, n, least, w, lambda x: F.percentile(x, F.lit(q)))


def diff(c: str | Column, k: int, w: WindowSpec) -> Column:
    return col(c) - F.lag(c, k).over(w)


def last_known(c: str | Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running(c: str | Column, w: WindowSpec, f: Callable[[Column], Column] = F.sum) -> Column:
    return f(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(total: str | Column, w: WindowSpec) -> Column:
    """A running total less its running maximum."""
    return col(total) - running(total, w, F.max)


def islands(changed: Column, w: WindowSpec) -> Column:
    """Number of the run a row belongs to; changed is true where a run starts."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def tie_rank(c: str, *keys: str) -> Column:
    """Average rank of equal values."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def first_touch(c: str, horizon: int, hit: Callable[[Column], Column], w: WindowSpec, start: int = 1) -> Column:
    """The least k in start..horizon whose value k rows ahead is a hit; horizon + 1 if none is."""
    found = [F.when(hit(F.lead(c, k).over(w)), F.lit(k)) for k in range(start, horizon + 1)]
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(horizon + 1))


def contiguous(ts: str, back: int, ahead: int, step: int, w: WindowSpec) -> Column:
    """Whether ``back`` rows before and ``ahead`` rows after lie exactly ``step`` seconds apart."""
    before = col(ts) - F.lag(ts, back).over(w) == back * step if back else F.lit(True)
    after = F.lead(ts, ahead).over(w) - col(ts) == ahead * step if ahead else F.lit(True)
    return F.coalesce(before & after, F.lit(False))
