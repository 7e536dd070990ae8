"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, exact Hamming checks, components.

The fingerprint takes one vote per word shingle and bit. Two fingerprints that differ in at most
``radius`` bits agree on all but ``radius`` of ``blocks`` bit blocks, so they meet under the mask of
some ``blocks - radius`` blocks. Documents are first reduced to distinct fingerprints, so thousands
of copies cost one row.

A bucket of a mask holds distinct fingerprints; from each bucket come at most (size - 1) links, those
of a forest over what lies within the radius, never all its pairs. One shuffle deals the buckets. One
above ``crowded`` is not scanned but dealt again, by ``blocks`` blocks of the bits that its mask leaves free;
close pairs share such a finer bucket too, so no link is lost. For radius 3 it fixes 52 bits or more
of 64, so it holds 2^12 fingerprints at most.

Links may be held to a second fingerprint: ``keep_one`` finds candidates by three-word shingles and
keeps those whose five-word fingerprints agree on 0.8 of their bits or more.

Cases: a null or wordless text has fingerprint zero and links like any other; equal rows share a
component; a null id is never a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each_text, map_batches, whole_key

CHUNK = 1 << 16
#: Odd numbers that mix a hash.
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit majority of the XXH64 (seed 42) of the text's lower-cased word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    total = len(found) - shingle + 1
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = found[start : min(start + CHUNK, total) + shingle - 1]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 42) for w in zip(*(part[k:] for k in range(shingle)), strict=False)), dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, second: int | None = None) -> DataFrame:
    """One row (id, hash, fp, near) per document: XXH64 of its text and the signed longs of its fingerprints; near is 0 without a second shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(fingerprint(t, shingle), fingerprint(t, second) if second else 0) for t in each_text(b)]
            marks = np.array(got, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=["id", "hash", "fp", "near"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))
    return map_batches(rows, run, "id long, hash long, fp long, near long")


def masks(blocks: int, radius: int, free: int = (1 << 64) - 1) -> np.ndarray:
    """Masks of every choice of blocks - radius blocks of the free bits of 64."""
    bits = [b for b in range(64) if free >> b & 1]
    edges = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    return np.array([sum(chosen) for chosen in combinations(parts, blocks - radius)], dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """Fingerprints link within radius bits; limit: and their second fingerprints within so many."""

    radius: int = 3
    blocks: int = 6
    crowded: int = 1024
    limit: int = 64
    finer: int = 8

    def close(self, fp: np.ndarray, near: np.ndarray, to_fp: np.ndarray, to_near: np.ndarray) -> np.ndarray:
        met = np.bitwise_count(fp ^ to_fp) <= self.radius
        return met if self.limit >= 64 else met & (np.bitwise_count(near ^ to_near) <= self.limit)


def forest(fp: np.ndarray, near: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Places of groups of two and more fingerprints that chains of links join."""
    if len(fp) <= 256 and int(rule.close(fp[:, None], near[:, None], fp, near).sum()) == len(fp):
        return []
    left, out = np.arange(len(fp)), []
    while len(left):
        group, wave, left = [left[:1]], left[:1], left[1:]
        while len(wave) and len(left):
            met = np.zeros(len(left), dtype=bool)
            for v in wave:
                met |= rule.close(fp[left], near[left], fp[v], near[v])
            wave, left = left[met], left[~met]
            group.append(wave)
        if sum(map(len, group)) > 1:
            out.append(np.concatenate(group))
    return out


def tree(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of child and parent) that hold a group together, one less than its members.

    A member's hash gives it a level, each level a sixteenth of the one below; it links to the next higher member in hash
    order. So no member has many links in a bucket, and buckets that share members mostly give the same links.
    """
    h = marks * MIX
    h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    level, rest, at = np.zeros(len(h), np.int64), h[order], np.arange(len(h))
    while len(at := at[(rest[at] & np.uint64(15)) == 0]) and level[at[0]] < 15:
        level[at] += 1
        rest[at] >>= np.uint64(4)
    child, parent = [], []
    for k in range(int(level.max()) + 1):
        mine, higher = np.flatnonzero(level == k), np.flatnonzero(level > k)
        if len(higher):
            child.append(mine)
            parent.append(higher[np.searchsorted(higher, mine) % len(higher)])
        else:
            child.append(mine[1:])
            parent.append(np.full(len(mine) - 1, mine[0]))
    return order[np.concatenate(child)], order[np.concatenate(parent)]


LINKS = "fp long, near long, to_fp long, to_near long, mask int"


def _links(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key): links of each run of equal (mask, key), or the members of a crowded one, mask set."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key: tuple[int, int] | None = None
    none = np.zeros(0, np.uint64)

    def close() -> tuple[list, int]:
        fp, near = held[0] if len(held) == 1 else tuple(np.concatenate(x) for x in zip(*held, strict=True))
        if len(fp) < 2:
            return [none] * 4, -1
        if rule.crowded and len(fp) > rule.crowded:
            return [fp, near, fp, near], key[0]
        marks = fp if rule.limit >= 64 else fp ^ near * ODD
        groups = forest(fp, near, rule)
        a, z = (np.concatenate(x) for x in zip((none.astype(int),) * 2, *((g[c], g[p]) for g in groups for c, p in (tree(marks[g]),)), strict=True))
        return [fp[a], near[a], fp[z], near[z]], -1

    def rows(found: list[tuple[list, int]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*(c for c, _ in found), strict=True)]
        of = np.concatenate([np.full(len(c[0]), m, np.int32) for c, m in found])
        return pa.RecordBatch.from_arrays([*columns, pa.array(of)], names=["fp", "near", "to_fp", "to_near", "mask"])

    for b in batches:
        if not b.num_rows:
            continue
        m, k, fp, near = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp", "near"))
        fp, near = fp.view(np.uint64), near.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        lone = np.r_[ends - starts == 1]
        lone[[0, -1]] = False  # runs at a batch's ends may go on
        out: list[tuple[list, int]] = []
        for s, e in zip(starts[~lone].tolist(), ends[~lone].tolist(), strict=True):
            if s or key != (m[0], k[0]):
                if held:
                    out.append(close())
                key, held = (m[s], k[s]), []
            held.append((fp[s:e], near[s:e]))
        if out:
            yield rows(out)
    if held:
        yield rows([close()])


def _redealt(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Members of crowded buckets under every finer mask; the key holds the bits of both masks."""
    coarse = masks(rule.blocks, rule.radius)
    finer = max(rule.finer, rule.radius + 3)
    inner = [masks(finer, rule.radius, ~int(c) & ((1 << 64) - 1)) for c in coarse]
    for b in batches:
        mask, fp, near = (b.column(c).to_numpy() for c in ("mask", "fp", "near"))
        for m in np.unique(mask).tolist():
            mine = mask == m
            for part in np.array_split(np.flatnonzero(mine), max(1, int(mine.sum()) >> 10)):
                keys = fp[part].view(np.uint64)[:, None] & (inner[m] | coarse[m])
                n = len(inner[m])
                of = np.tile(m * n + np.arange(n, dtype=np.int32), len(part)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp[part], n)), pa.array(np.repeat(near[part], n))], names=["mask", "key", "fp", "near"])


def _scan(rows: DataFrame, rule: Rule) -> DataFrame:
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return map_batches(dealt, lambda it: _links(it, rule), LINKS)


def links(marks: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Links (fp, near, to_fp, to_near) whose components are those of the rule.

    marks: (fp, near), distinct and materialised.
    """
    under = F.array(*[F.col("fp").bitwiseAND(F.lit(int(m))) for m in masks(rule.blocks, rule.radius).view(np.int64)])
    buckets = marks.select("fp", "near", F.posexplode(under).alias("mask", "key"))
    found = cut(_scan(buckets, rule))
    out, crowd = found.filter("mask < 0"), found.filter("mask >= 0").select("mask", "fp", "near")
    if not crowd.isEmpty():
        fine = map_batches(crowd, lambda it: _redealt(it, rule), "mask int, key long, fp long, near long")
        out = out.unionByName(_scan(fine, replace(rule, crowded=0)))
    return cut(out.drop("mask").dropDuplicates())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component; edges: (a, b), materialised.

    Each round every node goes to the least node next to it, and on to where that one goes; then links are renamed, and
    those inside a node or told twice are dropped. So links shrink from round to round, and rounds grow with the logarithm of
    a component's width. Minima are combined before each shuffle.
    """
    links = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").dropDuplicates())
    labels = links.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("label"))
    while not links.isEmpty():
        least = cut(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")))
        goes = cut(least.join(least.select(F.col("a").alias("to"), F.col("to").alias("on")), "to").select("a", "on"))
        labels = cut(labels.join(goes, labels["label"] == goes["a"], "left").select("node", F.coalesce("on", "label").alias("label")))
        renamed = links.join(goes, "a").select(F.col("on").alias("x"), "b").join(goes.select(F.col("a").alias("b"), F.col("on").alias("y")), "b")
        links = cut(renamed.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).dropDuplicates())
    return labels


def node(rule: Rule, fp: str = "fp", near: str = "near") -> Column:
    """A long for each mark: the fingerprint, or where a second one counts the XXH64 of both."""
    return F.col(fp) if rule.limit >= 64 else F.xxhash64(fp, near)


def classes(marked: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(node, n, label, first) for each distinct mark; marked: (id, hash, fp, near), materialised.

    n counts its rows; first (no_id, id, hash) is the least row of its class, null ids last; label is the class's least node.
    """
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("first")
    reps = cut(marked.groupBy("fp", "near").agg(F.count("*").alias("n"), least))
    edges = links(reps.select("fp", "near"), rule).select(node(rule).alias("a"), node(rule, "to_fp", "to_near").alias("b"))
    labels = components(cut(edges))
    grouped = cut(reps.select(node(rule).alias("node"), "n", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    firsts = cut(grouped.groupBy("label").agg(F.min("first").alias("first")))
    return cut(grouped.drop("first").join(firsts, "label").select("node", "n", "label", "first"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, rule: Rule = Rule(), hot: int = 1000) -> DataFrame:
    """One row per document: id, fp (signed long), label and component (least id of those reachable).

    Fingerprints of more than 1 in ``hot`` documents, so fewer than ``hot``, are sent to every task: their rows don't move.
    """
    marked = cut(with_fingerprint(docs, text_col, id_col, shingle))
    found = classes(marked, rule).select(F.col("node").alias("fp"), "n", "label", F.col("first.id").alias("component"))
    many = F.col("n") * hot > marked.count()
    crowd, rest = found.filter(many).drop("n"), found.filter(~many).drop("n")
    rows = marked.select("id", "fp")
    common = rows.join(F.broadcast(crowd), "fp")
    others = rows.join(F.broadcast(crowd.select("fp")), "fp", "left_anti").join(rest, "fp")
    return common.unionByName(others).select("id", "fp", "label", "component")


#: Candidates within 9 bits of three-word fingerprints, five-word ones alike on 0.8 of 64 bits or more.
ALIKE = Rule(radius=9, blocks=11, crowded=1 << 15, limit=12)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, second: int = 5, rule: Rule = ALIKE) -> DataFrame:
    """The document with the least id of each class, with its columns; one of several rows that share that id and text."""
    marked = cut(with_fingerprint(docs, text_col, id_col, shingle, second))
    first = classes(marked, rule).select("label", "first").distinct().select("first.*")
    names = ["key_id", "key_null", "key_text"]
    chosen = first.select(F.coalesce("id", F.lit(0)).alias("key_id"), F.col("no_id").alias("key_null"), F.col("hash").alias("key_text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *whole_key(id_col, text_col))
    return rows.join(chosen, names, "left_semi").dropDuplicates(names).select("doc.*")


def hexed(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
