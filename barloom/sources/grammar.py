"""Names and types of bar columns, made from a grammar rather than listed.

A bar file holds two markets' columns side by side, then optional streams, then a version. A market's
columns are {market}_{series}_{stat}, {market}_{side}_liq_{step}_{stat} and a few names of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

SIX = ("samples", "open", "close", "min", "median", "max")


@dataclass(frozen=True)
class Grammar:
    markets: tuple[str, ...] = ("spot", "future")
    series: tuple[str, ...] = ("bid", "ask", "spread", "micro_dev")
    near_steps: tuple[float, ...] = (0.01, 0.02, 0.05)
    deep_steps: tuple[float, ...] = (0.1, 0.2, 0.4)
    trades: tuple[str, ...] = ("buy_samples", "sell_samples", "buy_qty", "sell_qty", "buy_vwap", "sell_vwap")
    optional: tuple[str, ...] = ("open_interest", "funding")
    extra: tuple[str, ...] = field(default=())

    def market(self) -> list[str]:
        """A market's columns without its prefix."""
        out = ["datetime", "timestamp", "price_diff", *self.trades]
        out += [f"{s}_{x}" for s in self.series for x in SIX]
        for side in ("bid", "ask", "diff"):
            out += [f"{side}_liq_{step:.4}_{x}" for step in self.near_steps for x in SIX]
            out += [f"{side}_liq_{step:.4}_median" for step in self.deep_steps]
        return [*out, *self.extra]

    def columns(self) -> list[str]:
        """Markets' columns in pairs, then optional ones, then the version."""
        pairs = [f"{m}_{c}" for c in self.market() for m in self.markets]
        return [*pairs, *(f"opt_{c}" for c in self.optional), "schema_version"]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, kind(c)) for c in self.columns()])


def kind(column: str) -> T.DataType:
    if column.endswith("_datetime"):
        return T.StringType()
    if column.endswith(("_timestamp", "_samples")) or column == "schema_version":
        return T.LongType()
    return T.DoubleType()


def series_of(columns: list[str], market: str) -> list[str]:
    """Series of a market that come with all six stats."""
    found: dict[str, set[str]] = {}
    for c in columns:
        if m := re.fullmatch(rf"{market}_(.+)_({'|'.join(SIX)})", c):
            found.setdefault(m[1], set()).add(m[2])
    return sorted(s for s, stats in found.items() if stats == set(SIX))
