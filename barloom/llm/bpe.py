"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can never end up in one
token, whatever the merges do. Every such pair is a certain cut: a word falls into short fragments
that are merged independently and concatenated. Fragments recur far more often than words, so both
are remembered, within bounds.

White space never survives into a token of this family (the splitter drops it), so a text is encoded
word by word; special tokens hold no white space either and are found inside words. Normalising and
splitting a word follows the tokenizer file itself; merging is done here.

Cases: a null text counts as empty and gives no tokens and an empty decoded text; repeated rows are
encoded as often as they come; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, state

#: Letters and signs for which normalising is lower-casing: printable ASCII and Latin-1 letters.
PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Words remembered, as many from before, and a quarter as many fragments; some 300 bytes each.
REMEMBERED = 400_000
INFINITE = 1 << 60


class Encoder:
    """Encodes words of one tokenizer file; ids as int32 bytes, tokens as text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in merges]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        #: Ranks of all pairs that stand side by side inside some token; any other pair is a certain cut.
        self.joined = {pair: self.ranks.get(pair[0] << 20 | pair[1], INFINITE) for token in self.vocab for pair in self._pairs(token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        parts = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(parts[0])
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in byte]
        self.letter = {b: chr(b) for b in byte} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = {c: self.vocab[c] for c in self.letter.values()}
        self.last = {c: self.vocab[c + self.end] for c in self.letter.values()}
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.before: dict[bytes, tuple[bytes, str]] = {}

    def _pairs(self, token: str) -> Iterator[tuple[int, int]]:
        """The neighbouring start symbols inside a token; the end mark belongs to the last symbol."""
        ended = self.end and token.endswith(self.end) and len(token) > len(self.end)
        body = token[: -len(self.end)] if ended else token
        try:
            ids = [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end if ended else body[-1]]]
        except KeyError:  # a special token is never built by merges
            return iter(())
        return zip(ids, ids[1:], strict=False)

    def _merge(self, ids: list[int], near: list[int]) -> list[int]:
        """Merges a fragment, near its neighbours' ranks: lowest rank first, leftmost among equals."""
        if len(ids) > 100:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        while near:
            r = min(near)
            if r == INFINITE:
                break
            k = near.index(r)
            ids[k : k + 2] = (new := made[r],)
            del near[k]
            if k < len(near):
                near[k] = get(new << 20 | ids[k + 1], INFINITE)
            if k:
                near[k - 1] = get(ids[k - 1] << 20 | new, INFINITE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for fragments without a bound."""
        n, get = len(ids), self.ranks.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j], right[k], right[j] = self.made[r], -1, right[j], -1
            if (j := right[k]) >= 0:
                left[j] = k
                if (r := get(ids[k] << 20 | ids[j])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[j]))
            if (j := left[k]) >= 0 and (r := get(ids[j] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (r, j, ids[j], ids[k]))
        return [i for i in ids if i >= 0]

    def _fragment(self, ids: list[int], near: list[int]) -> list[int]:
        key = tuple(ids)
        found = self.fragments.get(key)
        if found is None:
            found = self._merge(ids, near)
            if len(key) <= 32:
                if len(self.fragments) >= REMEMBERED // 4:
                    self.fragments.clear()
                self.fragments[key] = found
        return found

    def _piece(self, piece: str) -> list[int]:
        """Tokens of one piece of the splitter, in byte letters: cut where no token can reach over."""
        ids = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        near = list(map(self.joined.get, zip(ids, ids[1:], strict=False)))
        if None not in near:
            return self._merge(ids, near)
        out, start = [], 0
        for k, rank in enumerate(near, 1):
            if rank is None:
                out += self._fragment(ids[start:k], near[start : k - 1]) if k - start > 1 else ids[start:k]
                start = k
        return out + self._fragment(ids[start:], near[start:])

    def _word(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.special_at.split(word) if self.special_at and self.special_at.search(word) else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                for p in self.split.findall(part.lower()):
                    out += self._piece(p)
            elif PLAIN.fullmatch(part):
                for p in self.split.findall(part.lower()):
                    out += self._piece("".join(map(self.letter.__getitem__, p.encode())))
            elif part:
                for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part)):
                    out += self._piece(p)
        return out

    def word(self, word: bytes) -> tuple[bytes, str]:
        """(ids as int32 bytes, tokens joined by a space) of a word without ASCII white space."""
        found = self.before.get(word)
        if found is None:
            ids = self._word(word.decode())
            found = array("i", ids).tobytes(), " ".join(map(self.tokens.__getitem__, ids))
            if len(word) > 64:
                return found
        if len(self.known) >= REMEMBERED:  # the words met since the last time stay at hand
            self.before = dict(self.known)
            self.known.clear()
        self.known[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as int32 bytes, decoded text): the file has no decoder, so tokens are joined by a space."""
        words = text.encode().split()
        if not words:
            return b"", ""
        found = list(map(self.known.get, words))
        if None in found:
            word = self.word
            found = [f or word(w) for f, w in zip(found, words, strict=True)]
        ids, tokens = zip(*found, strict=True)
        return b"".join(ids), " ".join(tokens if "" not in tokens else filter(None, tokens))


def _batches(batches: Iterator[pa.RecordBatch], path: str, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    enc = state(("bpe", path), lambda: Encoder(path))
    for b in batches:
        ids, rows = b.column("id"), b.column("text")
        start = 0
        while start < len(rows):
            got, held = [], 0
            while start + len(got) < len(rows) and held < size:
                got.append(enc.encode(rows[start + len(got)].as_py() or ""))
                held += len(got[-1][0]) + len(got[-1][1])
            offsets = np.cumsum([0, *(len(g[0]) // 4 for g in got)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(g[0] for g in got), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(got)), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([g[1] for g in got], pa.string())], names=["id", "ids", "decoded"])
            start += len(got)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ids array<int>, decoded string."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, lambda it: _batches(it, path), "id long, ids array<int>, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    done = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
    return done.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
