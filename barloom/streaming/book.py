"""A live order book: keyed state of price levels, fed by changes in sequence order.

Rows of a micro-batch come unordered, so a key's rows are sorted by sequence number before they are
applied. A change at or below the last number is stale and ignored; a jump beyond the next number
is counted, and the book keeps going from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..workers import reachable

OUT = "book long, seq long, best_bid double, bid_qty double, best_ask double, ask_qty double, n_levels long, stale long"


def apply_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, last, stale = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ({}, -1, 0)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for side, price, qty, seq in zip(rows["side"], rows["price"], rows["qty"], rows["seq"], strict=True):
        if seq <= last:
            stale += 1
            continue
        last = int(seq)
        level = f"{side}{price!r}"
        if qty > 0:
            held[level] = float(qty)
        else:
            held.pop(level, None)
    state.update((json.dumps(held), last, stale))
    bids = {float(k[3:]): q for k, q in held.items() if k.startswith("bid")}
    asks = {float(k[3:]): q for k, q in held.items() if k.startswith("ask")}
    bid, ask = max(bids, default=None), min(asks, default=None)
    yield pd.DataFrame({"book": [key[0]], "seq": [last], "best_bid": [bid], "bid_qty": [bids.get(bid)], "best_ask": [ask], "ask_qty": [asks.get(ask)], "n_levels": [len(held)], "stale": [stale]})


def live_book(changes: DataFrame) -> DataFrame:
    """Best prices of each book after each micro-batch; changes: book, side, price, qty, seq."""
    reachable(changes.sparkSession)
    return changes.groupBy("book").applyInPandasWithState(apply_changes, OUT, "levels string, seq long, stale long", "update", GroupStateTimeout.NoTimeout)
