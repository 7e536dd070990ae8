"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a word; the
dynamic programme carries for each position only the best score, its piece count and its bare bytes,
never a path. Ties follow the tokenizers library's unigram model: candidates for an end are met by
ascending start and the first of the best stays; a character that is no piece itself may stand as
unknown at the least score less 10, and an unknown character counts as its UTF-8 bytes.

Words are cut apart at ASCII white space, and each gets the word mark in front unless it bears one.

Cases: a null text counts as empty with no tokens and score 0; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, state, each_text

MARK = "▁"
PENALTY = 10.0
REMEMBERED = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file in the order of ids."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.vocab_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.known: dict[bytes, tuple[int, int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, int, float]:
        """(pieces, bare bytes among them, score) of the best segmentation."""
        n, unknown = len(text), self.unknown
        best, count, bare = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        at = 0  # ends before this one are settled
        single = False
        top = None

        def settle(end: int) -> None:
            """The unknown candidate starts last, so it wins only if strictly better."""
            nonlocal top
            if not single and (top is None or best[end - 1] + unknown > best[end]):
                size = len(text[end - 1].encode())
                best[end], count[end], bare[end] = best[end - 1] + unknown, count[end - 1] + size, bare[end - 1] + size

        for stop, (size, score) in self.automaton.iter(text):
            end = stop + 1
            while at < end:
                if at:
                    settle(at)
                at, single, top = at + 1, False, None
            start = end - size
            value = best[start] + score
            if top is None or value > top:
                top = best[end] = value
                count[end], bare[end] = count[start] + 1, bare[start]
            single = single or size == 1
        while at < n + 1:
            if at:
                settle(at)
            at, single, top = at + 1, False, None
        return count[n], bare[n], best[n]

    def word(self, word: bytes) -> tuple[int, int, float]:
        found = self.known.get(word)
        if found is None:
            text = word.decode()
            found = self.viterbi(text if text.startswith(MARK) else MARK + text)
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def text(self, text: str) -> tuple[int, int, int, float]:
        """(words, tokens, bare bytes, score) of a text."""
        known, word = self.known, self.word
        found = [known.get(w) or word(w) for w in text.encode().split()]
        if not found:
            return 0, 0, 0, 0.0
        tokens, bare, score = zip(*found, strict=True)
        return len(found), sum(tokens), sum(bare), float(sum(score))


def _batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = state(("unigram", path), lambda: Counter(vocabulary(path)))
    for b in batches:
        got = [counter.text(t) for t in each_text(b)]
        columns = list(zip(*got, strict=True)) if got else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["id", "n_words", "n_tokens", "n_bytes", "score"])


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_tokens, n_bytes (tokens that are bare bytes), score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, lambda it: _batches(it, path), "id long, n_words long, n_tokens long, n_bytes long, score double")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
    return counted.select(F.col("id").alias("doc_id"), "n_words", "n_tokens", "n_bytes", "score")
