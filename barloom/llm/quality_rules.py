"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback cuts every word of a text; a text is then measured by its
characters per token, the share of its tokens that are bare bytes, and the entropy of its tokens.
Bands are set for each language and length class (floor of log2 of the token count) from all
documents that pass the base rules: the median, and a scale that is twice the distance from the
median to the upper quartile, since junk gathers below. A text is rejected outside a wide band of one
measure, or low on both at once. The scale has a floor, so that a crowd of copies can't narrow a band.

Bands need ``least`` documents; a class with fewer takes the class over all languages, then the band of
all lengths of its language, then that of all documents, then a fixed one, so every text is judged.
Bands of all lengths hold entropy less what is usual for the length (``USUAL``). Bands take one point for equal measures, so copies count once.

Cases: a null text counts as empty and fails the base rules; a null language is a language of its own;
a text without words has n_tokens 0 and no measures; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, each_text, map_batches, small, state

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Words whose tokens are remembered, and the longest that is.
REMEMBERED, LONGEST = 200_000, 64
#: Texts of one batch whose words are cut together, in characters.
TOGETHER = 1 << 20
#: Words beyond which windows are counted by numbers.
MANY = 4096
#: Median entropy by length class, the last for all longer ones (medians over sf0.1 documents from 2^6 tokens on).
USUAL = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 5.8, 6.09, 6.36, 6.57, 6.72, 6.83, 6.9, 7.0)


@dataclass(frozen=True)
class Bands:
    """Widths in scales; floors of the scales; middle and scale of characters per token where too few documents set a band."""

    cpt: float = 6.0
    entropy: float = 5.0
    joint: float = 1.75
    cpt_floor: float = 0.05
    entropy_floor: float = 0.15
    bytes_most: float = 0.2
    least: int = 40
    cpt_fixed: tuple[float, float] = (2.2, 0.4)


class Cutter:
    """Tokens of words under a sentencepiece vocabulary, each word by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.lib.is_byte(i) for i in range(self.lib.vocab_size())])
        self.known: dict[str, bytes] = {}

    def learn(self, found: set[str]) -> dict[str, bytes]:
        """Tokens (int32 bytes) of these words; those of short words are remembered."""
        known = self.known
        new = [w for w in found if w not in known]
        cuts = {w: np.array(ids, dtype=np.int32).tobytes() for w, ids in zip(new, self.lib.encode(new, num_threads=1), strict=True)} if new else {}
        long = {w: x for w, x in cuts.items() if len(w) > LONGEST}
        if len(known) + len(cuts) > REMEMBERED:
            out = {w: known[w] for w in found if w in known} | cuts
            known.clear()
            known.update((w, x) for w, x in cuts.items() if len(w) <= LONGEST)
            return out
        known.update((w, x) for w, x in cuts.items() if len(w) <= LONGEST)
        return known if not long else {w: known[w] for w in found if w in known} | long


def base(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more; a text of many words is counted by the numbers of its words."""
    if len(words) > MANY:
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        two = np.unique(at[:-1] * len(place) + at[1:], return_inverse=True)[1]
        _, which, times = np.unique(two[:-1] * len(place) + at[2:], return_inverse=True, return_counts=True)
        often = times[which] > 1
        hit = np.zeros(len(words), dtype=bool)
        for k in range(3):
            hit[k : len(often) + k] |= often
        return int(hit.sum())
    windows = list(zip(words, words[1:], words[2:], strict=False))
    again = 0
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        reach = 0
        for k, w in enumerate(windows):
            if w in often:
                again += k + 3 - max(reach, k)
                reach = k + 3
    return again


def split_words(text: str) -> list[str]:
    """bytes.split() parts at the six ASCII blanks alone, str.split() at more."""
    return text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().split()]


def together(found: Iterator[str]) -> Iterator[list[str]]:
    """Runs of texts of about TOGETHER characters; a longer text stands alone."""
    rows, size = [], 0
    for t in found:
        rows.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _measure(batches: Iterator[pa.RecordBatch], path: str, carried: tuple[str, ...] = ("id", "lang")) -> Iterator[pa.RecordBatch]:
    cutter = state(("cutter", path), lambda: Cutter(path))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens"]
    for b in batches:
        out: list[tuple] = []
        for rows in together(each_text(b)):
            split = [split_words(t) for t in rows]
            cuts = cutter.learn({w for words in split for w in words})
            for text, words in zip(rows, split, strict=True):
                ids = np.frombuffer(b"".join([cuts[w] for w in words]), dtype=np.int32)
                if len(ids):
                    share = np.bincount(ids)
                    bare = int(share[cutter.is_byte[: len(share)]].sum())
                    share = share[share > 0] / len(ids)
                    out.append((*base(text, words), len(ids), bare, abs(float(-(share * np.log2(share)).sum()))))
                else:
                    out.append((*base(text, words), 0, 0, None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.float64())], names=[*carried, *names, "entropy"])


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, entropy double"


def derived(measured: DataFrame) -> DataFrame:
    """Adds base_failed, chars_per_token, byte_share and the class (group, length) to measured rows."""
    return (
        measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("chars_per_token", F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")))
        .withColumn("byte_share", F.when(F.col("n_tokens") > 0, F.col("n_byte_tokens") / F.col("n_tokens")))
        .withColumn("group", F.coalesce("lang", F.lit("")))
        .withColumn("length", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    )


def measures(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang, the base figures, token figures and entropy in bits, and what derives from them."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return derived(map_batches(rows, lambda it: _measure(it, path), f"id long, lang string, {FIGURES}"))


def usual() -> Column:
    """The usual entropy of a row's length class."""
    return F.element_at(F.array(*map(F.lit, USUAL)), F.least(F.col("length"), F.lit(len(USUAL) - 1)) + 1)


def learn_bands(measured: DataFrame, bands: Bands) -> tuple[DataFrame, ...]:
    """Bands by (group, length), by length, by group and over all, as tables of a row for each class."""
    points = measured.filter("not base_failed").select("group", "length", "chars_per_token", "entropy").distinct()
    points = cut(points.withColumn("rest", F.col("entropy") - usual()).withColumn("any", F.lit(0)))

    def scaled(keys: list[str], tag: str, entropy: str) -> DataFrame:
        quarters = [F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.75)), 10000).alias(name) for name, c in (("c", "chars_per_token"), ("e", entropy))]
        got = points.groupBy(*keys).agg(F.count("*").alias("n"), *quarters).filter(F.col("n") >= bands.least)
        mid, scale = (lambda c: F.col(c)[0].alias(f"{c}_mid{tag}")), (lambda c, floor: F.greatest(2 * (F.col(c)[1] - F.col(c)[0]), F.lit(floor)).alias(f"{c}_scale{tag}"))
        return cut(got.select(*keys, mid("c"), scale("c", bands.cpt_floor), mid("e"), scale("e", bands.entropy_floor)))

    return scaled(["group", "length"], "", "entropy"), scaled(["length"], "_all", "entropy"), scaled(["group"], "_group", "rest"), scaled(["any"], "_any", "rest")


def judge(measured: DataFrame, learned: tuple[DataFrame, ...], bands: Bands) -> DataFrame:
    """Adds kept. Bands have a row a class: sent to every task, no text moves and no large class meets in one task."""
    seen = measured.withColumn("any", F.lit(0))
    for table, keys in zip(learned, (["group", "length"], ["length"], ["group"], ["any"]), strict=True):
        seen = seen.join(small(table), keys, "left")
    pick = lambda c, shift, fixed: F.coalesce(F.col(c), F.col(f"{c}_all"), F.col(f"{c}_group") + shift, F.col(f"{c}_any") + shift, F.lit(fixed) + shift)
    none = F.lit(0.0)
    c = (F.col("chars_per_token") - pick("c_mid", none, bands.cpt_fixed[0])) / pick("c_scale", none, bands.cpt_fixed[1])
    e = (F.col("entropy") - pick("e_mid", usual(), 0.0)) / pick("e_scale", none, bands.entropy_floor)
    odd = (F.abs(c) > bands.cpt) | (e < -bands.entropy) | ((c < -bands.joint) & (e < -bands.joint))
    rejected = F.col("base_failed") | F.coalesce(odd, F.lit(False)) | F.coalesce(F.col("byte_share") > bands.bytes_most, F.lit(False))
    return seen.withColumn("kept", ~rejected).select(*measured.columns, "kept")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rated(docs: DataFrame, path: str | None = None, bands: Bands = Bands()) -> DataFrame:
    """One row per document with its measures and verdict."""
    measured = cut(measures(docs, path or default_path()))
    return judge(measured, learn_bands(measured, bands), bands)


def keep(docs: DataFrame, path: str | None = None, bands: Bands = Bands(), text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their columns; texts are measured twice rather than shuffled or stored."""
    path = path or default_path()
    learned = learn_bands(measures(docs, path, text_col, id_col, lang_col), bands)
    columns = {"lang": (lang_col, pa.string()), "text": (text_col, pa.string())}
    measured = attach(docs, columns, lambda it: _measure(it, path, ("doc", "lang")), f"lang string, {FIGURES}")
    return judge(derived(measured), learned, bands).filter("kept").select("doc.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("entropy", 6).alias("entropy")
    )
