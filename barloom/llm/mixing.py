"""Mixing sources to target weights by Sainte-Laguë apportionment.

A mix asks for a share of words from each source. The mix's blocks of ``block`` words are given to the
sources by highest quotients target / (2k + 1), then each source's blocks to its shards by the same
rule on the shards' sizes. Inside a shard documents stand in an order seeded by their id, their words
form one stream, and the shard's quota takes the stream's blocks in that order: whole passes first,
then the leading blocks of the next pass. So a document is cut at most where a quota ends.

A shard is the documents of a source whose seeded hash falls together; a source has one for each
``shard_words`` words, so that a hot source is dealt over many tasks. Sources and shards are tables:
their number has no limit. Targets and quotas come from rounds of sums over these tables; the driver
sees those sums alone.

Equal rows (of equal id, source, text and other columns) are counted first and stand in the stream one
after the other, so any number of them is one row of the plan.

Cases: a null source is a source of its own, last; a null or wordless text has size 0 and takes
nothing; null ids and repeated rows are mixed as rows of their own, in a fixed order; without words,
targets are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, cut, map_batches, n_words, each_text, whole_key

WEIGHTS = (3, 1, 2)
KEY = ["key_id", "key_null", "key_text", "key_source", "key_row"]
#: Divisors tried at once; so many rounds exhaust a double.
TRIED, ROUNDS = 32, 16


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds at, the place of each row in the order, from 0: rows of a range are numbered in their task, ranges by sums."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first")).orderBy("part").collect()  # a row a partition
    shift, total = [], 0
    for r in counts:
        shift.append((r["part"], total - r["first"]))
        total += r["n"]
    moved = rows.sparkSession.createDataFrame(shift, "part int, shift long")
    return dealt.join(F.broadcast(moved), "part").withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def capped_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Adds target to (size, weight): shares of total by weight, none above most * size; the excess goes to the others by weight.

    Each round closes the sources that the level fills; the level only rises, so a few sums settle it.
    """
    full = F.lit(False)
    live = sources.filter("size > 0")
    left = min(total, most * (live.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    level, closed = 0.0, -1
    while True:
        got = live.agg(F.sum(F.when(full, F.col("size") * most).otherwise(0.0)).alias("taken"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"), F.sum(full.cast("int")).alias("closed")).first()
        if not got["open"] or got["closed"] == closed:
            break
        closed, level = got["closed"], (left - got["taken"]) / got["open"]
        full = F.col("size") * most <= F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(F.col("size") <= 0, 0.0).otherwise(F.least(F.col("size") * F.lit(float(most)), F.lit(level) * F.col("weight"))))


def apportioned(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds seats to rows (keys, votes, most, place) by highest quotients votes / (2k + 1) in each group, none above most.

    groups: (keys, quota), one row each. Ties go to the lower place. A divisor gives each row its rounded votes; each round
    tries many divisors of each group between one that gives too many seats and one that doesn't, until no row can gain more than one.
    """
    votes, most = F.col("votes"), F.col("most")
    given = lambda d: F.when(votes > 0, F.least(most, F.floor(votes / d + 0.5).cast("long"))).otherwise(F.lit(0).cast("long"))
    live = cut(rows.filter("votes > 0 and most > 0"))
    sums = live.groupBy(*keys).agg(F.sum("votes").alias("all"), F.count("*").alias("n"), F.min("votes").alias("low"), F.max("most").alias("top"), F.sum("most").alias("limit"))
    state = groups.join(sums, keys).withColumn("quota", F.least("quota", "limit")).filter("quota > 0")
    # below low / (2 top) every row has its most; votes / divisor is off the seats by half a row at most, so the first tries lie
    # between all / (quota + n / 2) and all / (quota - n / 2), or 2 all, where no row has a seat
    half, full = F.col("n") / 2 + 1, F.col("all")
    low = F.col("low") / (2.0 * F.col("top") + 2)
    high = F.when(F.col("quota") > half, full / (F.col("quota") - half)).otherwise(2 * full + 1)
    state = cut(state.select(*keys, "quota", low.alias("lo"), high.alias("hi"), F.greatest(low, full / (F.col("quota") + half)).alias("from"), F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        open_ = state.filter("not done")
        if open_.isEmpty():
            break
        tries = F.transform(F.sequence(F.lit(0), F.lit(TRIED - 1)), lambda k: F.col("from") * F.pow(F.col("hi") / F.col("from"), k / TRIED))
        tried = open_.select(*keys, F.posexplode(tries).alias("nth", "divisor"))
        told = live.join(tried, keys).groupBy(*keys, "nth").agg(F.first("divisor").alias("divisor"), F.sum(given(F.col("divisor"))).alias("seats"))
        fits = F.col("seats") <= F.col("quota")
        told = told.join(open_.select(*keys, "quota"), keys).groupBy(*keys).agg(F.max(F.when(~fits, F.col("divisor"))).alias("new_lo"), F.min(F.when(fits, F.col("divisor"))).alias("new_hi"), F.max(F.when(fits, F.col("seats") == F.col("quota"))).alias("met"))
        lo, hi = F.coalesce("new_lo", "lo"), F.coalesce("new_hi", "hi")
        state = cut(state.join(told, keys, "left").select(*keys, "quota", lo.alias("lo"), hi.alias("hi"), lo.alias("from"), (F.col("done") | F.coalesce("met", F.lit(False))).alias("done")))
        # between the two divisors no row gains more than a seat: the rest is a matter of quotients
        gains = live.join(state.filter("not done"), keys).groupBy(*keys).agg(F.max(given(F.col("lo")) - given(F.col("hi"))).alias("gain"))
        state = cut(state.join(gains, keys, "left").withColumn("done", F.col("done") | (F.coalesce("gain", F.lit(0)) <= 1)).drop("gain"))
    seated = cut(rows.join(state, keys, "left").withColumn("seats", F.coalesce(given(F.col("hi")), F.lit(0).cast("long"))))
    short = cut(seated.groupBy(*keys).agg((F.first("quota") - F.sum("seats")).alias("rest")).filter("rest > 0"))
    own = ["quota", "lo", "hi", "from", "done"]
    if short.isEmpty():
        return seated.drop(*own)
    next_ = seated.filter((votes > 0) & (given(F.col("lo")) > F.col("seats"))).join(short, keys).withColumn("quotient", votes / (2 * F.col("seats") + 1))
    placed = cut(numbered(next_.select(*keys, "place", "quotient", "rest"), *map(F.col, keys), F.desc("quotient"), F.col("place")))
    firsts = placed.groupBy(*keys).agg(F.min("at").alias("first"))
    more = placed.join(firsts, keys).filter("at - first < rest").select(*keys, "place", F.lit(1).cast("long").alias("extra"))
    return seated.join(cut(more), [*keys, "place"], "left").withColumn("seats", F.col("seats") + F.coalesce("extra", F.lit(0))).drop("extra", *own)


def by_order(weights: tuple[int, ...] = WEIGHTS):
    """Weights that repeat over the sources in code-point order, null last; at is a source's place."""
    return lambda at: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))


def hashed_row(docs: DataFrame) -> Column:
    """XXH64 of all columns; maps, which have no hash, as JSON."""
    flat = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*flat)


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """Columns without nulls that tell rows apart unless all their columns are equal."""
    source = F.col(source_col).cast("string")
    return [*whole_key(id_col, text_col), F.xxhash64(F.coalesce(source, F.lit("")), source.isNull()).alias("key_source"), hashed_row(docs).alias("key_row")]


def mix(
    docs: DataFrame,
    weigh=None,
    share: float = 1.5,
    most_passes: int = 2,
    block: int = 16,
    shard_words: int = 1 << 20,
    seed: int = 11,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row for each set of n equal documents: id, source, size, source_size, target, n, passes, full, part and its key.

    The mix takes ``passes`` whole copies of each of them, ``full`` of them once more, and of one more its first ``part`` words.
    weigh: a source's weight by its place.
    """
    weigh = weigh or by_order()
    text = F.col(text_col).cast("string")
    listed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (n_words(text) if size is None else size.cast("long")).alias("size"),
        *keyed(docs, id_col, source_col, text_col),
    )
    rows = cut(listed.groupBy("id", "source", "size", *KEY).agg(F.count("*").alias("n")))
    sizes = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")))
    ordered = numbered(sizes, F.col("source").asc_nulls_last())
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    named = cut(capped_targets(ordered.withColumn("weight", weigh(F.col("at"))), share * total, most_passes))
    asked = math.floor((named.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]) / block + 0.5)
    spark = docs.sparkSession
    sources = named.select("source", F.col("size").alias("source_size"), "target", F.col("target").alias("votes"), (most_passes * F.ceil(F.col("size") / block)).alias("most"), F.col("at").alias("place"), F.lit(0).alias("mix"), F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words)).cast("long").alias("n_shards"))
    sources = cut(apportioned(sources, spark.createDataFrame([(0, asked)], "mix int, quota long"), ["mix"]).select(F.col("place").alias("k"), F.col("source").alias("s"), "source_size", "target", "n_shards", F.col("seats").alias("blocks")))
    at = F.xxhash64(F.lit(seed), "id", F.when(F.col("id").isNull(), F.col("key_text")))
    dealt = _with_sources(rows.withColumn("at", at), sources).withColumn("shard", F.pmod(F.xxhash64("at", F.lit(seed)), "n_shards"))
    shards = cut(dealt.groupBy("k", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("n_blocks", F.ceil(F.col("words") / block)))
    seats = apportioned(shards.select("k", "shard", "words", "n_blocks", F.col("words").cast("double").alias("votes"), (most_passes * F.col("n_blocks")).alias("most"), F.col("shard").alias("place")), sources.select("k", F.col("blocks").alias("quota")), ["k"])
    quotas = cut(seats.select("k", "shard", "words", "n_blocks", F.col("seats").alias("quota")))
    dealt = dealt.join(quotas, ["k", "shard"])
    order = Window.partitionBy("k", "shard").orderBy("at", *KEY)
    whole = F.col("size") * F.col("n")
    end = F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passes = F.least(F.floor(F.col("quota") / F.greatest("n_blocks", F.lit(1))), F.lit(most_passes)).cast("long")
    placed = dealt.withColumn("start", end - whole).withColumn("passes", passes)
    reach = F.least((F.col("quota") - F.col("passes") * F.col("n_blocks")) * block, F.col("words"))
    placed = placed.withColumn("last", F.greatest(F.lit(0), F.least(whole, reach - F.col("start"))).cast("long"))
    full = F.when(F.col("size") > 0, F.floor(F.col("last") / F.col("size"))).otherwise(0).cast("long")
    return placed.withColumn("full", full).select("id", "source", "size", "source_size", "target", "n", "passes", "full", (F.col("last") - F.col("full") * F.col("size")).alias("part"), *KEY)


def _with_sources(rows: DataFrame, sources: DataFrame, few: int = 10_000) -> DataFrame:
    """Rows beside their source: up to ``few`` sources go to every task, so that a hot one moves no rows; more meet them in a join that splits hot ones."""
    known = F.broadcast(sources) if sources.count() <= few else sources
    return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def taken(plan: DataFrame) -> DataFrame:
    """One row per document, with the words that the mix takes of it; equal documents in an order of their own."""
    steps = 1 << 12
    runs = plan.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / steps))))
    each = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * steps, F.least(F.col("n"), (F.col("run") + 1) * steps) - 1)))
    more = F.when(F.col("nth") < F.col("full"), F.col("size")).when(F.col("nth") == F.col("full"), F.col("part")).otherwise(0)
    return each.withColumn("taken", (F.col("passes") * F.col("size") + more).cast("long")).drop("run", "nth", "n", "passes", "full", "part")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def leading(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for k, m in enumerate(_WORD.finditer(text), 1):
        end = m.end()
        if k == n:
            break
    return text[:end]


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [leading(t, n) for t, n in zip(each_text(b), b.column("last").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(got, pa.string())], names=["doc", "cut"])


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", count_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself, with the documents' columns: a row for each whole copy, and a last one cut where a quota ends.

    At most one document of a shard is cut; its character count follows. Equal documents need no telling apart: each gives its
    whole passes, and one for all gives what a quota's end takes of them.
    """
    plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    plan = cut(plan.filter("passes > 0 or full > 0 or part > 0").select(*KEY, "n", "passes", "full", "part"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *keyed(docs, id_col, source_col, text_col))
    met = rows.join(plan, KEY)
    each = F.col("passes") + F.when(F.col("full") == F.col("n"), 1).otherwise(0)
    copies = met.select("doc", F.explode(F.array_repeat(F.lit(1), each.cast("int")))).select("doc.*")
    # where a quota ends: at most one set of equal documents a shard
    ends = plan.filter("part > 0 or (full > 0 and full < n)")
    ended = cut(rows.join(ends, KEY).groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("doc", "full", "n", "part")]))
    steps = 1 << 12
    full = F.when(F.col("full") == F.col("n"), 0).otherwise(F.col("full"))
    runs = ended.select("doc", full.alias("full")).filter("full > 0").select("doc", "full", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("full") - 1) / steps))).alias("run"))
    more = runs.select("doc", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(steps), F.col("full") - F.col("run") * steps).cast("int")))).select("doc.*")
    part = ended.filter("part > 0").select("doc", F.col("doc").getField(text_col).cast("string").alias("text"), F.col("part").alias("last"))
    trimmed = map_batches(part, _lead, beside(T.StructField("doc", part.schema["doc"].dataType), "cut string"))
    fields = []
    for c in docs.columns:
        own = F.col("cut") if c == text_col else F.char_length("cut").cast("long") if c == count_col else F.col("doc").getField(c)
        fields.append(own.cast(docs.schema[c].dataType).alias(c))
    return copies.unionByName(more).unionByName(trimmed.select(*fields))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
