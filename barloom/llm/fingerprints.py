"""Document fingerprints (SimHash) with DataFrame functions only, and search within a Hamming radius.

Terms are pairs of neighbouring words, ASCII letters lower-cased (the last word stands alone as well,
so a single word is a term). A term's hash votes on each of 64 bits with the term's weight: 1 to 3 by
the letters of its first word, since long words are rare. A bit is 1 if its ones outweigh its zeros.
Votes for two bits share one long, 32 bits each; a text has at most 2^30 words and weights end at 3, so
no vote spills over. Votes are summed where a text lies, before anything is shuffled.

Search splits fingerprints into blocks; those within the radius agree on all but ``radius`` of them,
so tables permuted to any ``blocks - radius`` blocks find every one. Equal fingerprints are counted
first, so copies cost one row.

Cases: a null or wordless text has fingerprint zero; documents order by id, null ids lowest, ties by
text; a lone document follows itself; repeated rows are documents of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, words

LANE = 1 << 32 | 1
#: Characters of a bucket of neighbours, and the most bounds of buckets that go to the driver.
BUCKET_CHARS, MOST_BUCKETS = 1 << 22, 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinted(df: DataFrame, keys: list[str], text: str, name: str = "fp") -> DataFrame:
    """One row for each of keys, which tell the rows apart, with the text's fingerprint."""
    found = words(lower_ascii(F.col(text)))
    listed = df.select(*keys, found.alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words), 1))").alias("b"))
    terms = listed.select(*keys, F.explode_outer(pairs).alias("t")).select(*keys, F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    weight = F.when(F.col("a").isNull(), 0).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.length("a") - 3))).cast("long")
    hashed = terms.select(*keys, weight.alias("w"), F.xxhash64("a", "b").alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANE)) * F.col("w")).alias(f"v{k}") for k in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *votes)
    bits: Column = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{k}", 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("w"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        bits = bits.bitwiseOR(F.when(2 * high > F.col("w"), F.lit(signed(1 << (k + 32)))).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, bits.alias(name))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def in_order(docs: DataFrame, id_col: str, text_col: str, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(bucket, at, halo, id, text): buckets of consecutive ids, each led by the row before it.

    Quantiles of the ids bound the buckets, one for each ``bucket_chars`` characters of text (at most MOST_BUCKETS
    longs go to the driver; beyond that buckets grow, and their sorts spill). Every bound is an id, so the row that
    precedes a bucket is the last of the one below and is sent to both; the lowest bucket is led by the highest
    document. No order over all rows is ever made.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    told = rows.agg(F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0)).alias("chars"), F.max("id").alias("top")).first()
    wanted = max(2, min(MOST_BUCKETS, told["chars"] // bucket_chars + 1))
    got = rows.agg(F.percentile_approx("id", F.lit(np.arange(1, wanted) / wanted), 4 * wanted + 1000).alias("q")).first()
    bounds, top = sorted(set(got["q"] or [])), told["top"]
    step = (len(bounds) + 1).bit_length()  # binary search: how many bounds lie below the id
    padded = F.lit(np.array(bounds + [(1 << 63) - 1] * ((1 << step) - len(bounds)), dtype=np.int64))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(step))])
    below = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.element_at(padded, at + h) < F.col("id"), at + h).otherwise(at))
    placed = rows.withColumn("bucket", F.coalesce(below, F.lit(0)))
    placed = placed.withColumn("edge", F.coalesce(F.element_at(padded, F.col("bucket") + 1) == F.col("id"), F.lit(False)))
    homes = F.array_compact(
        F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo")),
            F.when(F.col("edge"), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("halo"))),
            F.when(F.col("id").eqNullSafe(F.lit(top)), F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("halo"))),
        )
    )
    dealt = placed.select("id", "text", F.explode(homes).alias("home")).select("home.bucket", "home.halo", "id", "text")
    order = Window.partitionBy("bucket").orderBy(F.col("halo").desc(), F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    return dealt.select("bucket", "halo", "id", "text", F.row_number().over(order).alias("at"), F.lag("text").over(order).alias("next_text"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fp, edited_fp, next_fp.

    The next document is the one with the next smaller id. One shuffle carries the texts; the votes,
    the pivot and the second look at the neighbour stay inside its partitions.
    """
    rows = in_order(docs, id_col, text_col)
    n = F.char_length("text").cast("long")
    moved = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - int(n_chars) div 3)"), F.coalesce(F.substr("next_text", F.lit(1), moved), F.lit(""))))
    keys = ["bucket", "at", "halo", "id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    marked = fingerprinted(both, [*keys, "which"], "body")
    pivoted = marked.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    near = pivoted.withColumn("next_fp", F.lag("fp").over(Window.partitionBy("bucket").orderBy("at")))
    return near.filter("not halo").drop("bucket", "at", "halo")


def permuted(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius blocks of 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def within(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6, fp_col: str = "fp") -> DataFrame:
    """(query, fp, n): every distinct fingerprint of the index within the radius of a distinct query, and its rows."""
    masks = F.array(*[F.lit(m) for m in permuted(blocks, radius)])

    def tables(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select(F.col(name), *more, F.posexplode(F.transform(masks, lambda m: F.col(name).bitwiseAND(m))).alias("mask", "key"))

    asked = tables(queries.select(F.col(fp_col).alias("query")).distinct(), "query")
    held = tables(index.groupBy(F.col(fp_col).alias("fp")).agg(F.count("*").alias("n")), "fp", "n")
    met = asked.join(held, (asked["mask"] == held["mask"]) & (asked["key"] == held["key"]) & (F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius))
    return met.groupBy("query", "fp").agg(F.first("n").alias("n"))


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = cut(edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    asked, others = found.filter(F.col("id") % 100 == 0), found.filter(~F.coalesce(F.col("id") % 100 == 0, F.lit(False)))
    near = within(asked, found).groupBy("query").agg(F.sum("n").alias("n_within"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    counted = asked.join(near, F.col("fp") == F.col("query")).drop("query").unionByName(others.withColumn("n_within", F.lit(None).cast("long")))
    return counted.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("n_within").cast("long").alias("n_within"),
    )
