"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node keeps zeros and ones under every context of up to
``depth`` preceding bytes. The Krichevsky-Trofimov estimates of all depths are mixed with the weights
that context-tree weighting gives them after the training texts: a node keeps its own estimate with
half its prior weight, its children share the other half. The mixture is then fixed and every text is
coded with it: score is log10 of the text's probability, its last symbol being the end of the text.

No context is left out: the tree grows with the corpus and is a distributed table. Windows (a context of
``depth`` bytes, then its symbol) are dealt by their last ``SHARED`` context bytes, so a task has whole
subtrees; the nodes above, of at most 256 ** SHARED contexts, are mixed on the driver. The table has the
windows of all texts, those without training counts too, so each window of a text meets its code. The
most common ``crowd`` windows go to every task, the others meet their codes in a join.

The base score is a smoothed unigram model over words. Words seen in at least 1 in ``frequent``
training tokens (so at most ``frequent`` of them) go to every task; the others meet their counts in a
join. Words are told apart by XXH64.

Texts are lower-cased in A-Z. Cases: a null text counts as empty and holds the end alone; a null id is
not held out; repeated rows score alike and count as often as they come; without training texts every
count is 0 and every decision has probability 1/2.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each_text, forget, map_batches, pieces, state

WORD, GRAM, UNTRAINED = 0, 1, 2
#: The key of a text's end among words: no word hashes from an empty string.
END = int(np.uint64(xxhash.xxh64_intdigest(b"")).astype(np.int64))
#: Counts held in a task before they are handed on, windows counted at once, log10 steps of a code.
HELD, WINDOWS, UNIT = 400_000, 1 << 18, 1 << 24
#: Bytes of texts counted or scored at once, counts handed on at once.
PIECE, ROWS = 1 << 20, 1 << 16
#: Context bytes whose subtrees stay together, windows of subtrees taken at once, the multiplier of the window table's hash, its empty slot (UTF-8 has no byte 255).
SHARED, SUBTREE, MIX, EMPTY = 2, 1 << 16, np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: Stirling's series after eight steps up."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y - np.log(shift)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)


def nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decision nodes, level by level, from counts of 256 bytes."""
    parts = [counts.reshape(len(counts), 1 << j, 2, 1 << (7 - j)).sum(-1) for j in range(8)]
    return np.concatenate([p[:, :, 0] for p in parts], 1), np.concatenate([p[:, :, 1] for p in parts], 1)


def spread(zero: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probability of a zero at each node."""
    out = np.zeros((len(zero), 256))
    for j in range(8):
        p = zero[:, (1 << j) - 1 : (1 << (j + 1)) - 1]
        both = np.log10(np.stack([p, 1 - p], -1)).reshape(len(zero), 2 << j)
        out += np.repeat(both, 1 << (7 - j), axis=1)
    return out


@dataclass
class Level:
    """Decision nodes that occur under contexts of one length (context << 8 | node, ascending), their counts and ln of their weighted probability; up: places in the level above."""

    nodes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    logs: np.ndarray
    up: np.ndarray | None = None

    def mixed(self, told: np.ndarray, left: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a zero told so far, and the weight left to longer contexts."""
        share = 1.0 if last else np.exp(np.minimum(0.0, estimate(self.zeros, self.ones) - math.log(2) - self.logs))
        return told + left * share * (self.zeros + 0.5) / (self.zeros + self.ones + 1), left * (1 - share)


def lowest(keys: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of the longest contexts, and the places of each window's eight nodes."""
    context, symbol = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    every = np.concatenate([context | np.uint64(1 << j) | symbol >> np.uint64(8 - j) for j in range(8)])
    one = np.concatenate([symbol >> np.uint64(7 - j) & np.uint64(1) for j in range(8)]).astype(bool)
    found, where = np.unique(every, return_inverse=True)
    times = np.tile(n.astype(np.float64), 8)
    zeros, ones = (np.bincount(where, weights=times * x, minlength=len(found)) for x in (~one, one))
    return Level(found, zeros, ones, estimate(zeros, ones)), where.reshape(8, -1)


def raised(level: Level, d: int) -> Level:
    """The level of contexts of d bytes above that of d + 1."""
    found, level.up = np.unique(level.nodes & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
    zeros, ones, split = (np.bincount(level.up, weights=x, minlength=len(found)) for x in (level.zeros, level.ones, level.logs))
    return Level(found, zeros, ones, np.logaddexp(estimate(zeros, ones), split) - math.log(2))


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, low: int) -> tuple[list[Level], np.ndarray]:
    """Levels from ``depth`` up to ``low`` for windows that make up whole subtrees."""
    level, where = lowest(keys, n)
    levels = [level]
    for d in range(depth - 1, low - 1, -1):
        levels.append(raised(levels[-1], d))
    return levels, where


def above(level: Level, low: int) -> tuple[np.ndarray, np.ndarray]:
    """What contexts shorter than ``low`` tell of each node of that level, and the weight they leave."""
    levels = [level]
    for d in range(low - 1, -1, -1):
        levels.append(raised(levels[-1], d))
    told, left = np.zeros(len(levels[-1].nodes)), np.ones(len(levels[-1].nodes))
    for k in range(low, 0, -1):
        told, left = levels[k].mixed(told, left, False)
        told, left = told[levels[k - 1].up], left[levels[k - 1].up]
    return told, left


def coded(keys: np.ndarray, levels: list[Level], where: np.ndarray, told: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 in units of each window's symbol after its context."""
    for k in range(len(levels) - 1, -1, -1):
        told, left = levels[k].mixed(told, left, k == 0)
        if k:
            told, left = told[levels[k - 1].up], left[levels[k - 1].up]
    zero = np.clip(told, 1e-12, 1 - 1e-12)[where]
    one = np.stack([keys >> np.uint64(7 - j) & np.uint64(1) for j in range(8)]).astype(bool)
    return np.rint(np.log10(np.where(one, 1 - zero, zero)).sum(0) * UNIT).astype(np.int32)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, n, m) of runs of whole subtrees; rows come sorted by top."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < SUBTREE:
            continue
        whole = pa.Table.from_batches(held)
        top = whole.column("top").to_numpy()
        end = int(np.searchsorted(top, top[-1]))
        held = whole.slice(end).combine_chunks().to_batches()
        if end:
            yield _windows_of(whole.slice(0, end))
    if held:
        yield _windows_of(pa.Table.from_batches(held))


def _windows_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n, m = (rows.column(c).to_numpy() for c in ("key", "n", "m"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    return key[order], n[order], m[order]


def _tops(batches: Iterator[pa.RecordBatch], depth: int, low: int) -> Iterator[pa.RecordBatch]:
    forget()
    for keys, n, _ in _subtrees(batches):
        level = subtree(keys, n, depth, low)[0][-1]
        yield pa.RecordBatch.from_arrays([pa.array(level.nodes.view(np.int64)), pa.array(level.zeros), pa.array(level.ones), pa.array(level.logs)], names=["node", "zeros", "ones", "logs"])


def _codes(batches: Iterator[pa.RecordBatch], depth: int, low: int, shared) -> Iterator[pa.RecordBatch]:
    forget()
    tops, told, left = shared.value
    for keys, n, m in _subtrees(batches):
        levels, where = subtree(keys, n, depth, low)
        at = np.searchsorted(tops, levels[-1].nodes)
        code = coded(keys, levels, where, told[at], left[at])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(m), pa.array(code)], names=["key", "m", "code"])


@dataclass
class Model:
    """A tree held in memory. child[row, byte]: the row of the context one byte longer, or -1; code: log10 in units, by row and byte."""

    depth: int
    child: np.ndarray
    code: np.ndarray


def weigh(depth: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """levels[d]: contexts of d bytes (uint64, the last byte lowest, ascending) and their counts of 256 bytes."""
    parents, others, logs, shares, kts = [], [], [], [], []
    for d in range(1, depth + 1):
        keys = levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)
        parents.append(np.searchsorted(levels[d - 1][0], keys))
    for d in range(depth + 1):
        rest = levels[d][1].copy()
        if d < depth:
            np.subtract.at(rest, parents[d], levels[d + 1][1])
        others.append(np.maximum(rest, 0))
    for d in range(depth, -1, -1):
        a, b = nodes(levels[d][1])
        own = estimate(a, b)
        kts.insert(0, (a + 0.5) / (a + b + 1))
        if d == depth:
            logs.insert(0, own)
            shares.insert(0, np.ones_like(own))
            continue
        split = estimate(*nodes(others[d]))
        np.add.at(split, parents[d], logs[0])
        logs.insert(0, np.logaddexp(own, split) - math.log(2))
        shares.insert(0, np.exp(np.minimum(0.0, own - math.log(2) - logs[0])))
        logs[1] = None
    rows = np.cumsum([0, *(len(k) for k, _ in levels)])
    child = np.full((rows[-1], 256), -1, dtype=np.int32)
    code = np.empty((rows[-1], 256), dtype=np.int32)
    told = left = None
    for d in range(depth + 1):
        own, share = kts[d], shares[d]
        if d:
            child[rows[d - 1] + parents[d - 1], (levels[d][0] >> np.uint64(8 * (d - 1))).astype(np.int64)] = np.arange(rows[d], rows[d + 1])
            told, left = told[parents[d - 1]], left[parents[d - 1]]
            told, left = told + left * share * own, left * (1 - share)
        else:
            told, left = share * own, 1 - share
        a, b = nodes(others[d])
        code[rows[d] : rows[d + 1]] = np.rint(spread(np.clip(told + left * (a + 0.5) / (a + b + 1), 1e-12, 1 - 1e-12)) * UNIT)
    return Model(depth, child, code)


def stream(rows: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array, each after ``depth`` zeros and before a zero that ends it, and where their symbols start."""
    flat = np.frombuffer(b"\0" * depth + (b"\0" * max(depth, 1)).join(rows) + b"\0", dtype=np.uint8)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return flat, depth + np.concatenate([[0], np.cumsum(sizes[:-1] + max(depth, 1))])


def chunked(rows: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes; a longer text stands alone."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r) + 8
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(rows: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of depth + 1 bytes (context, then symbol) and the places of their texts, in runs of a bounded size."""
    base = 0
    for part in chunked(rows, WINDOWS):
        flat, starts = stream(part, depth)
        sizes = np.array([len(r) + 1 for r in part])
        for s in range(depth, len(flat), WINDOWS):
            at = np.arange(s, min(s + WINDOWS, len(flat)))
            first, last = np.searchsorted(starts, [s, s + len(at)], "left")
            text = np.zeros(len(at), dtype=np.int64)
            text[starts[first:last] - s] = 1
            text = np.cumsum(text) + (first - 1)
            inside = at - starts[text] < sizes[text]
            at, text = at[inside], text[inside]
            key = np.zeros(len(at), dtype=np.uint64)
            for k in range(depth, -1, -1):
                key = key << np.uint64(8) | flat[at - k]
            yield key, text + base
        base += len(part)


def grams(rows: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct windows and their counts."""
    for key, _ in windows(rows, depth):
        yield np.unique(key, return_counts=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    forget()
    seen: Counter = Counter()
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], UNTRAINED: []}

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), ROWS):
            key = keys[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n[k : k + ROWS].astype(np.int64))], names=["kind", "key", "n"])

    def told() -> Iterator[pa.RecordBatch]:
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
        n = np.fromiter(seen.values(), np.int64, len(seen))
        seen.clear()
        yield from rows(WORD, keys, n)

    for b in (p for b in batches for p in pieces(b, PIECE)):
        dealt: dict[int, list[bytes]] = {GRAM: [], UNTRAINED: []}
        for t, train in zip(each_text(b), b.column("train").to_pylist(), strict=True):
            t = t.encode("utf-8", "surrogatepass").lower()
            dealt[GRAM if train else UNTRAINED].append(t)
            if train:
                seen.update(t.split())
                seen[b""] += 1
                if len(seen) > HELD:
                    yield from told()
        for kind, got in dealt.items():
            for part in grams(got, depth):
                parts[kind].append(part)
                if sum(len(k) for k, _ in parts[kind]) > 4 * HELD:
                    parts[kind] = [summed(parts[kind])]
                    if len(parts[kind][0][0]) > 2 * HELD:
                        yield from rows(kind, *parts[kind][0])
                        parts[kind] = []
    if seen:
        yield from told()
    for kind, left in parts.items():
        if left:
            yield from rows(kind, *summed(left))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def window_codes(counts: DataFrame, depth: int) -> DataFrame:
    """(key, m, code) of every window; counts: (key, n in training texts, m in all texts), materialised."""
    sc = counts.sparkSession.sparkContext
    low = min(SHARED, depth)
    dealt = counts.withColumn("top", F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * low) - 1)).cast("int"))
    dealt = dealt.repartition("top").sortWithinPartitions("top")
    got = map_batches(dealt, lambda it: _tops(it, depth, low), "node long, zeros double, ones double, logs double").toArrow()  # at most 255 * 256 ** SHARED rows
    nodes = got.column("node").to_numpy().view(np.uint64)
    order = np.argsort(nodes)
    top = Level(nodes[order], *(got.column(c).to_numpy()[order] for c in ("zeros", "ones", "logs")))
    shared = sc.broadcast((top.nodes, *above(top, low)))
    out = cut(map_batches(dealt, lambda it: _codes(it, depth, low, shared), "key long, m long, code int"))
    shared.unpersist()
    return out


def common_windows(codes: DataFrame, crowd: int) -> pa.Table:
    """(key, code) of the most common windows, whole classes of like counts, ``crowd`` at most."""
    kind = F.floor(F.log2("m") * 4).cast("int")
    least, held = None, 0
    for r in codes.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect():  # four rows for each doubling
        held += r["count"]
        if held > crowd:
            break
        least = r["kind"]
    return codes.filter(kind >= least if least is not None else F.lit(False)).select("key", "code").toArrow()


class Windows:
    """Codes by window: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        k = np.arange(len(keys))
        slot = np.maximum.accumulate(home[order] - k) + k
        self.keys = np.full(max(1 << self.bits, int(slot[-1]) + 1 if len(slot) else 0) + 1, EMPTY)
        self.codes = np.zeros(len(self.keys), dtype=np.int32)
        self.keys[slot], self.codes[slot] = keys[order], codes[order]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the keys, 0 for those that are missing, and the places of the missing ones."""
        at = self._home(keys)
        met = self.keys[at]
        live = np.flatnonzero((met != keys) & (met != EMPTY))
        while len(live):
            at[live] += 1
            met = self.keys[at[live]]
            live = live[(met != keys[live]) & (met != EMPTY)]
        missing = np.flatnonzero(self.keys[at] != keys)
        out = self.codes[at]
        out[missing] = 0
        return out, missing


class Scorer:
    """Scores texts: frequent words by their hash, common windows by their codes."""

    def __init__(self, depth: int, keys: np.ndarray, codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        self.depth, self.table, self.hashes, self.counts = depth, Windows(keys, codes), hashes, counts
        self.logs = np.log10(counts + 0.1)
        self.known: dict[bytes, int] = {}

    def _learn(self, new: list[bytes]) -> list[int]:
        """The words' places among the frequent ones, or -1; those of short words are remembered."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        k = np.searchsorted(self.hashes, h)
        met = np.zeros(len(new), dtype=bool)
        inside = k < len(self.hashes)
        met[inside] = self.hashes[k[inside]] == h[inside]
        places = np.where(met, k, -1).tolist()
        if len(self.known) + len(new) >= HELD:
            self.known.clear()
        self.known.update((w, p) for w, p in zip(new, places, strict=True) if len(w) <= 64)
        return places

    def words(self, text: bytes) -> tuple[int, float, dict[bytes, int]]:
        """(frequent words, their sum of log10(c + 0.1), counts of the others)."""
        found = text.split()
        if not found:
            return 0, 0.0, {}
        places = list(map(self.known.get, found))
        if None in places:
            new = list({w for k, w in zip(places, found, strict=True) if k is None})
            got = dict(zip(new, self._learn(new), strict=True))
            places = [got[w] if k is None else k for k, w in zip(places, found, strict=True)]
        at = np.array(places, dtype=np.int64)
        common = at[at >= 0]
        rare = Counter([found[k] for k in np.flatnonzero(at < 0).tolist()]) if len(common) < len(at) else {}
        return len(common), float(self.logs[common].sum()), rare

    def codes(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of each text's common windows, and (text, window, count) of the others, by text."""
        units = np.zeros(len(rows), dtype=np.int64)
        others = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for key, text in windows(rows, self.depth):
            code, missing = self.table.find(key)
            units += np.bincount(text, weights=code, minlength=len(rows)).astype(np.int64)
            if len(missing):
                key, text = key[missing], text[missing]
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
                others.append((text[first], key[first], np.diff(np.r_[first, len(key)])))
        text, key, n = (np.concatenate(x) for x in zip(*others, strict=True))
        return units, text, key, n


def _score(batches: Iterator[pa.RecordBatch], shared, run: str) -> Iterator[pa.RecordBatch]:
    scorer = state(("ctw", run), lambda: Scorer(*shared.value))  # one table a worker, not a task
    for b in (p for b in batches for p in pieces(b, PIECE)):
        got = [t.encode("utf-8", "surrogatepass").lower() for t in each_text(b)]
        units, text, key, n = scorer.codes(got)
        ends = pa.array(np.searchsorted(text, np.arange(len(got) + 1)), pa.int32())
        words = [scorer.words(t) for t in got]
        rare_ends = pa.array(np.cumsum([0, *(len(r) for _, _, r in words)]), pa.int32())
        rare = [w for _, _, r in words for w in r]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, rare), np.uint64, len(rare)).view(np.int64)
        times = np.fromiter((n for _, _, r in words for n in r.values()), np.int64, len(rare))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("row"),
                b.column("id"),
                pa.array([c + sum(r.values()) + 1 for c, _, r in words], pa.int64()),
                pa.array([len(t) for t in got], pa.int64()),
                pa.array([c for c, _, _ in words], pa.int64()),
                pa.array([s for _, s, _ in words], pa.float64()),
                pa.array(units),
                pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())),
                pa.ListArray.from_arrays(rare_ends, pa.array(hashes)),
                pa.ListArray.from_arrays(rare_ends, pa.array(times)),
            ],
            names=["row", "id", "n_tokens", "n_bytes", "n_common", "common", "units", "windows", "often", "rare", "times"],
        )


def score_texts(docs: DataFrame, train: Column | None = None, depth: int = 5, crowd: int = 1 << 21, frequent: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, n_bytes, train_tokens, base_score, score, bits_per_byte.

    train: a boolean column over id; by default those not held out. crowd and frequent: windows and words sent to every task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    train = ~held_out(F.col("id")) if train is None else train
    counted = map_batches(rows.select("text", F.coalesce(train, F.lit(False)).alias("train")), lambda it: _count(it, depth), "kind int, key long, n long")
    counts = cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    told = counts.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("key") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    total, distinct, ends = told["n"], told["v"], told["ends"]
    often = counts.filter((F.col("kind") == WORD) & (F.col("n") * frequent >= total)).select("key", "n").toArrow()  # at most `frequent` rows
    hashes = often.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    trained = F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0))
    codes = window_codes(cut(counts.filter(F.col("kind") != WORD).groupBy("key").agg(trained.alias("n"), F.sum("n").alias("m"))), depth)
    common = common_windows(codes, crowd)
    shared = spark.sparkContext.broadcast((depth, common.column("key").to_numpy().view(np.uint64), common.column("code").to_numpy(), hashes[order], often.column("n").to_numpy()[order]))
    run = uuid.uuid4().hex
    lists = "windows array<long>, often array<long>, rare array<long>, times array<long>"
    schema = f"row long, id long, n_tokens long, n_bytes long, n_common long, common double, units long, {lists}"
    scored = cut(map_batches(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"), lambda it: _score(it, shared, run), schema))
    shared.unpersist()
    others = scored.filter(F.size("windows") > 0).select("row", F.explode(F.arrays_zip("windows", "often")).alias("x")).select("row", F.col("x.windows").alias("key"), F.col("x.often").alias("often"))
    more = others.join(codes.select("key", "code"), "key").groupBy("row").agg(F.sum(F.col("often") * F.col("code")).alias("more"))
    rare = scored.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    met = rare.join(counts.filter(F.col("kind") == WORD).select("key", "n"), "key", "left")
    log = lambda c: F.log10(c + F.lit(0.1))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen"), F.sum(F.col("times") * log(F.coalesce("n", F.lit(0)))).alias("logs"))
    whole = scored.drop("windows", "often", "rare", "times").join(sums, "row", "left").join(more, "row", "left")
    score = (F.col("units") + F.coalesce("more", F.lit(0))) / F.lit(float(UNIT))
    base = F.col("common") + F.coalesce("logs", F.lit(0.0)) + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (distinct + 1)))
    return whole.select(
        "id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("seen", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        "n_bytes",
        F.lit(total).cast("long").alias("train_tokens"),
        F.round(base, 6).alias("base_score"),
        score.alias("score"),
        (-score * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
