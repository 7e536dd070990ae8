"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

Features are word unigrams and bigrams, and unigrams to trigrams of word shapes (letter case, digits,
signs; runs squeezed), hashed into 2^18 places with square-root counts scaled to unit length. The
fit sees at most ``most`` labelled rows, those of the least seeded hash of their id; scoring covers
every row as a sparse dot product with the weights. The fit runs in one task, which keeps its rows in a
file, so neither the driver's memory nor that task's follows the texts; a long text is hashed in runs of words.

Cases: a null or wordless text has no features and scores by the bias; rows without a label or id
don't train; several labels of one id count as the least, and so do several texts; labels of one class or none at all leave the
bias alone (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, each_text, map_batches, pieces, state

BITS = 18
REMEMBERED = 300_000
#: A text of more bytes is hashed in runs of so many words.
LONG, RUN = 1 << 20, 1 << 16
#: Bytes of text whose features leave a task together.
TOGETHER = 1 << 22
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _hashes(word: bytes, known: dict[bytes, tuple[int, int]]) -> tuple[int, int]:
    found = zlib.crc32(word), zlib.crc32(_RUN.sub(rb"\1", word.translate(_SHAPE)))
    if len(word) <= 64:
        if len(known) >= REMEMBERED:
            known.clear()
        known[word] = found
    return found


def _places(pairs: list[tuple[int, int]], before: int = 0) -> np.ndarray:
    """Places of the n-grams that end at a word, the first ``before`` words (two at most) left out."""
    w, s = np.array(pairs, dtype=np.uint64).T
    mix = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    grams = [w[before:] * mix[0] + mix[1], s[before:] * mix[1] + mix[2]]
    if len(w) > 1:
        k = max(before - 1, 0)
        same = (w[k + 1 :] == w[k:-1]).astype(np.uint64)
        grams += [(w[k:-1] * mix[2] ^ w[k + 1 :] * mix[0]) + mix[3], (s[k:-1] * mix[3] ^ s[k + 1 :] * mix[1]) + mix[0], same[same > 0] * mix[2]]
    if len(w) > 2:
        grams.append((s[:-2] * mix[0] ^ s[1:-1] * mix[2] ^ s[2:] * mix[3]) + mix[1])
    flat = np.concatenate(grams)
    flat ^= flat >> np.uint64(29)
    flat *= mix[3]
    return (flat >> np.uint64(64 - BITS)).astype(np.int32)


def _counts_of_long(data: bytes, known: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a text of many words, which are never held together."""
    total, last, found = np.zeros(1 << BITS, np.int64), [], (m.group() for m in _WORD.finditer(data))
    while pairs := [known.get(w) or _hashes(w, known) for w in islice(found, RUN)]:
        total += np.bincount(_places(last + pairs, len(last)), minlength=1 << BITS)
        last = (last + pairs)[-2:]
    places = np.flatnonzero(total).astype(np.int32)
    return places, total[places]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a text's n-grams, places ascending."""
    known = state("classifier", dict)
    data = text.encode("utf-8", "surrogatepass")
    if len(data) > LONG:
        return _counts_of_long(data, known)
    pairs = [known.get(w) or _hashes(w, known) for w in data.split()]
    return np.unique(_places(pairs), return_counts=True) if pairs else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    values = np.sqrt(counts)
    return (values / np.sqrt((values * values).sum())).astype(np.float32) if len(counts) else np.zeros(0, np.float32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, places ascending."""
    places, counts = counted(text)
    return places, scaled(counts)


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps from place to place and counts, mostly small numbers, compressed byte by byte of equal weight."""
    numbers = np.stack([np.diff(places, prepend=0), counts]).astype("<u4")
    return zlib.compress(numbers.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1).tobytes()
    steps, counts = np.frombuffer(numbers, "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts.astype(np.int64)


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by follow-the-regularised-leader updates, in the rows' order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = bias = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for places, values, label in rows:
            zs, ns = z[places], n[places]
            w = weights(zs, ns)
            bias = -bz / ((beta + bn**0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values + bias, -35, 35)))
            g = (p - label) * values
            more = ns + g * g
            z[places] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[places] = more
            gb = float(p - label)
            bz += gb - ((bn + gb * gb) ** 0.5 - bn**0.5) / alpha * bias
            bn += gb * gb
    return weights(z, n).astype(np.float32), float(-bz / ((beta + bn**0.5) / alpha))


class Filed:
    """Rows (places, values, label) of batches in an unnamed file, read again by each pass."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.file, self.rows = tempfile.TemporaryFile(), []
        for b in batches:
            for label, row in zip(b.column("label").to_pylist(), b.column("packed"), strict=True):
                self.rows.append((self.file.write(row.as_buffer()), label))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        self.file.seek(0)
        for size, label in self.rows:
            places, counts = unpacked(self.file.read(size))
            yield places, scaled(counts).astype(np.float64), label


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights, bias = ftrl(Filed(batches))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8192, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Learns from labels whose id isn't held out, at most ``most`` of them."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    known = known.withColumn("at", F.xxhash64("id", F.lit(seed))).orderBy("at", "id").limit(most)
    found = _rows(docs, id_col, text_col).join(F.broadcast(known), "id")  # at most `most` rows of two numbers

    least = found.groupBy("at", "id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # a repeated id trains once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, TOGETHER)):
            rows = pa.array([packed(*counted(t)) for t in each_text(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("id"), b.column("label"), rows], names=["at", "id", "label", "packed"])

    got = map_batches(least.select("at", "id", "label", "text"), run, "at long, id long, label int, packed binary")
    ordered = got.repartition(1).sortWithinPartitions("at", "id")  # at most `most` rows
    model = map_batches(ordered.select("label", "packed"), _train, "weights binary, bias double").toArrow().to_pylist()
    return (np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def _score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, float], carried: str) -> Iterator[pa.RecordBatch]:
    weights, bias = model
    for b in batches:
        out = np.empty(b.num_rows)
        for k, t in enumerate(each_text(b)):
            places, values = features(t)
            out[k] = weights[places].astype(np.float64) @ values.astype(np.float64) + bias
        yield pa.RecordBatch.from_arrays([b.column(carried), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))], names=[carried, "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1)."""
    return map_batches(_rows(docs, id_col, text_col), lambda it: _score(it, model, "id"), "id long, score double")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``least``, with their columns."""
    scored = attach(docs, {"text": (text_col, pa.string())}, lambda it: _score(it, model, "doc"), "score double")
    return scored.filter(F.col("score") >= least).select("doc.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
