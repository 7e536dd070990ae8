"""Order-book operators: events stand for changes of levels, sequence numbers for update ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import along
from ..operators import book as K
from ..sources.tables import messages, table, tape
from .shared import TAPE, rounded

QUERIES, ORACLE = {}, {}
STEPS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def changes(spark, sf_dir):
    """Bids below 1000, asks above; the level comes from the message's JSON, an error deletes it."""
    m = messages(spark, sf_dir).filter("level is not null")
    bid = F.col("seq") % 2 == 0
    return m.select(
        (F.col("key") % 5).alias("book"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 1000.0 - F.col("level")).otherwise(1000.5 + F.col("level")).alias("price"),
        F.when(F.col("kind") == "error", 0.0).otherwise(F.col("value")).alias("qty"),
        "seq",
    )


CHANGES = """changes AS (SELECT user_id % 5 AS book, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN event_id % 2 = 0 THEN 1000.0 - k ELSE 1000.5 + k END AS price,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS qty, event_id AS seq FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL)"""
LEVELS = f"{CHANGES}, levels AS (SELECT book, side, price, arg_max(qty, seq) AS qty FROM changes GROUP BY ALL HAVING arg_max(qty, seq) > 0)"
BEST = f"{LEVELS}, best AS (SELECT book, max(price) FILTER (side = 'bid') AS best_bid, arg_max(qty, price) FILTER (side = 'bid') AS bid_qty, min(price) FILTER (side = 'ask') AS best_ask, arg_min(qty, price) FILTER (side = 'ask') AS ask_qty FROM levels GROUP BY book)"
NEAR = f"{BEST}, near AS (SELECT l.*, best_bid, best_ask, (best_bid + best_ask) / 2 AS mid, CASE WHEN side = 'bid' THEN (best_bid - price) / best_bid * 100 ELSE (price - best_ask) / best_ask * 100 END AS pct FROM levels l JOIN best USING (book))"


@query(f"WITH {LEVELS} SELECT book, side, CAST(price AS DOUBLE) AS price, round(qty, 6) AS qty FROM levels")
def book_asof_state(spark, sf_dir):
    return rounded(K.state_at(changes(spark, sf_dir), ["book"]))


@query(f"WITH {BEST} SELECT book, CAST(best_bid AS DOUBLE) AS best_bid, round(bid_qty, 6) AS bid_qty, CAST(best_ask AS DOUBLE) AS best_ask, round(ask_qty, 6) AS ask_qty FROM best")
def book_best(spark, sf_dir):
    return rounded(K.best(K.state_at(changes(spark, sf_dir), ["book"]), ["book"]))


@query(f"WITH {NEAR}, s AS (SELECT CAST(unnest({STEPS}) AS DOUBLE) AS step) SELECT book, step AS pct, round(coalesce(sum(qty) FILTER (side = 'bid' AND pct <= step + 1e-6), 0), 6) AS bid_liq, round(coalesce(sum(qty) FILTER (side = 'ask' AND pct <= step + 1e-6), 0), 6) AS ask_liq FROM near, s GROUP BY book, step")
def book_liquidity_bands(spark, sf_dir):
    return rounded(K.bands(K.state_at(changes(spark, sf_dir), ["book"]), ["book"], STEPS))


@query(f"""WITH {NEAR}, n AS (SELECT * FROM near WHERE pct <= 5.0), r AS (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY qty DESC, pct) AS k FROM n)
SELECT b.book, round(coalesce(max(qty) FILTER (side = 'bid'), 0), 6) AS bid_wall_qty, round(coalesce(max(abs(price - mid) / mid * 100) FILTER (side = 'bid'), -1), 6) AS bid_wall_dist, round(coalesce(max(qty) FILTER (side = 'ask'), 0), 6) AS ask_wall_qty,
  round(coalesce(max(abs(price - mid) / mid * 100) FILTER (side = 'ask'), -1), 6) AS ask_wall_dist FROM (SELECT DISTINCT book FROM levels) b LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (book) GROUP BY b.book""")
def book_wall(spark, sf_dir):
    return rounded(K.walls(K.state_at(changes(spark, sf_dir), ["book"]), ["book"], 5.0))


@query(f"WITH {BEST} SELECT book, round((bid_qty * best_ask + ask_qty * best_bid) / (bid_qty + ask_qty) - (best_bid + best_ask) / 2, 6) AS micro_dev FROM best")
def book_microprice(spark, sf_dir):
    top = K.best(K.state_at(changes(spark, sf_dir), ["book"]), ["book"])
    return rounded(top.select("book", K.microprice_deviation("best_bid", "best_ask", "bid_qty", "ask_qty").alias("micro_dev")))


@query(f"""WITH {TAPE}, q AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(qty) OVER w AS pq FROM tape WINDOW w AS (PARTITION BY stream, bar ORDER BY seq)),
o AS (SELECT stream, bar, coalesce(CASE WHEN pb IS NOT NULL THEN (CASE WHEN bid >= pb THEN qty ELSE 0 END) - (CASE WHEN bid <= pb THEN pq ELSE 0 END) - (CASE WHEN ask <= pa THEN qty ELSE 0 END) + (CASE WHEN ask >= pa THEN pq ELSE 0 END) END, 0) AS ofi, coalesce(CAST(bid <> pb AS INT), 0) AS bm, coalesce(CAST(ask <> pa AS INT), 0) AS am, coalesce(CAST(bid < pb AS INT), 0) AS bd, coalesce(CAST(ask > pa AS INT), 0) AS ad FROM q)
SELECT stream, bar, round(sum(ofi), 6) AS ofi, CAST(sum(bm) AS BIGINT) AS bid_moved, CAST(sum(am) AS BIGINT) AS ask_moved, CAST(sum(bd) AS BIGINT) AS bid_depleted, CAST(sum(ad) AS BIGINT) AS ask_depleted FROM o GROUP BY stream, bar""")
def book_ofi(spark, sf_dir):
    from ..operators.bars import with_bar
    from ..sources.tables import DAY

    flow = K.order_flow(with_bar(tape(spark, sf_dir), DAY), ("stream", "bar"), "seq", "bid", "ask", "qty", "qty")
    first = F.row_number().over(along("stream", "bar", by="seq")) == 1
    flow = flow.withColumn("ofi", F.when(first, 0.0).otherwise(F.col("ofi")))
    return rounded(flow.groupBy("stream", "bar").agg(F.sum("ofi").alias("ofi"), *[F.sum(c).alias(c) for c in ("bid_moved", "ask_moved", "bid_depleted", "ask_depleted")]))


@query(f"""WITH {CHANGES}, u AS (SELECT *, NULL::DOUBLE AS mid, 1 AS c FROM changes UNION ALL SELECT user_id % 5, NULL, NULL, NULL, event_id, 1000 + (event_id % 11) / 8.0, 0 FROM events WHERE event_type = 'click'),
m AS (SELECT * EXCLUDE (mid), last_value(mid IGNORE NULLS) OVER (PARTITION BY book ORDER BY seq, c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mid FROM u),
d AS (SELECT *, qty - coalesce(lag(qty) OVER (PARTITION BY book, side, price ORDER BY seq), 0) AS d, abs(price - mid) / mid * 100 AS p FROM m WHERE c = 1)
SELECT book, {', '.join(f"round(coalesce(sum({'d' if a == 'add' else '-d'}) FILTER (side = '{s}' AND p <= {pct} AND d {'>' if a == 'add' else '<'} 0), 0), 6) AS {a}_{s}_{b}" for b, pct in (('near', 2.0), ('wide', 10.0)) for s in ('bid', 'ask') for a in ('add', 'cancel'))} FROM d GROUP BY book""")
def book_add_cancel_flow(spark, sf_dir):
    """Clicks quote the mid; each change is judged by the mid before it."""
    m = messages(spark, sf_dir).filter("kind = 'click'")
    mids = m.select((F.col("key") % 5).alias("book"), "seq", (1000 + (F.col("seq") % 11) / 8).alias("mid"))
    return rounded(K.add_cancel(K.with_previous_mid(changes(spark, sf_dir), mids, ("book",)), ("book",), "mid", 2.0, 10.0))


DIFFS = "diffs AS (SELECT user_id % 5 AS book, event_id AS seq, event_id // 3 AS first, event_id // 3 + event_id % 4 AS last FROM events)"


@query(f"""WITH {DIFFS}, s AS (SELECT *, max(last) OVER (PARTITION BY book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM diffs)
SELECT book, seq, CASE WHEN seen IS NULL THEN 'start' WHEN last <= seen THEN 'stale' WHEN first <= seen + 1 THEN 'ok' ELSE 'gap' END AS status, CASE WHEN seen IS NOT NULL AND last > seen AND first > seen + 1 THEN first - seen - 1 ELSE 0 END AS missed FROM s""")
def book_depth_gap_audit(spark, sf_dir):
    m = messages(spark, sf_dir)
    diffs = m.select((F.col("key") % 5).alias("book"), "seq", F.floor(F.col("seq") / 3).cast("long").alias("first"), (F.floor(F.col("seq") / 3) + F.col("seq") % 4).cast("long").alias("last"))
    return K.sequence_audit(diffs, ("book",), "seq", "first", "last").select("book", "seq", "status", "missed")


@query("WITH g AS (SELECT user_id AS key, event_id AS id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS missed FROM events) SELECT * FROM g WHERE missed > 0")
def trade_id_gaps(spark, sf_dir):
    return K.id_gaps(messages(spark, sf_dir).select("key", F.col("seq").alias("id")), ("key",), "id", "id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS level, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'signup' THEN 'sell' END AS side, round(value * CAST(json_extract_string(props, '$.k') AS BIGINT), 6) AS notional FROM events")
def json_event_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("level", F.from_json("props", "k long").getField("k"))
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "signup", "sell")
    return rounded(rows.select("event_id", "level", side.alias("side"), (F.col("value") * F.col("level")).alias("notional")))


