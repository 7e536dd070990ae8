"""Main text of web pages: the contiguous run of words and tags with the largest sum.

A page is read once into words and tags. Every word scores by the elements it lies in, up to +1 or down
to -0.25; every tag scores negative; Kadane's linear scan finds the best run. Its blocks are the text,
less those whose own words score negative (an advert or a form inside an article).

Weights come from labelled pages: those that mark their content by exactly one ``article`` element, at
most ``most`` of them, taken by the least seeded hash of their id. A word's score is the log odds of a
logistic regression over the names of its elements: tags, and class, id and role tokens of containers.
It starts from ``PRIOR`` and keeps what the pages can't tell; without a prior it learns from the pages
alone. A tag's score is its log odds of lying in content.

An ``article`` or ``main`` starts afresh, whatever its wrappers are called, unless it is a reader's comment or
a teaser. Where such an element holds text that scores positive, text beside it scores negative.

Cases: a null or empty page has an empty text; a page without words that score positive too; cut-off
pages end where their html ends; of equal runs the first and longest is taken; without labelled
pages the prior holds; of more than 64 names around a word the outer ones count; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Elements of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select button audio video map".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img".split())
CONTAINERS = frozenset("aside details dialog div dl fieldset footer form header menu nav ol search section table ul".split())
CONTENT = frozenset("article main".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
ITEM = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z|(?=<))", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)")
END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
MOST_NAMES = 64

#: Parts of names that usually mark boilerplate, what readers or other pages say, content, or nothing.
MARKS = frozenset("ad ads advert advertisement alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget header complementary contentinfo form dialog".split())
READERS = frozenset("comment comments disqus related replies reply respond teaser teasers".split())
BODIES = frozenset("article body content entry main post story text".split())
PLAIN = frozenset("area block bottom box container group inner item items left list outer page right row section site top wrap wrapper".split())
WITHOUT = frozenset("has with no without".split())


@dataclass(frozen=True)
class Prior:
    """Weights before any page is seen, and how far from them pages may take a weight (its variance)."""

    names: dict[str, float] = field(default_factory=dict)
    firm: frozenset[str] = frozenset()
    start: float = 0.7
    lists: bool = True

    def variance(self, name: str) -> float:
        return 0.05 if name in self.firm else 4.0


#: Elements by their usual role; names of lists, tables and text elements tell little.
PRIOR = Prior(
    dict.fromkeys("nav footer aside form menu dialog search header".split(), -4.0) | {"a": -0.5, "article": 2.0, "main": 2.0, "mark": -3.5, "readers": -8.0, "body": 1.0, "beside": -4.0},
    frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tbody thead tfoot tr td th b i em strong figure figcaption blockquote pre code details a body article main".split()),
)
#: No word lists and no roles: what is known comes from the pages.
NOTHING = Prior(lists=False)


@dataclass(frozen=True)
class Weights:
    names: dict[str, float]
    tags: dict[str, float]
    start: float
    lists: bool
    scores: dict[frozenset[str], float] = field(default_factory=dict, compare=False)

    def word(self, scope: frozenset[str]) -> float:
        """Log odds of a word inside elements of these names."""
        got = self.scores.get(scope)
        if got is None:
            if len(self.scores) > 100_000:
                self.scores.clear()
            got = self.scores[scope] = self.start + sum(self.names.get(x, 0.0) for x in scope)
        return got

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.25)


def unlearned(prior: Prior = PRIOR) -> Weights:
    return Weights(dict(prior.names), {}, prior.start, prior.lists)


def role_of(token: str) -> str | None:
    """What a class or id token usually marks: its last telling part decides, "wrap" of both kinds tells nothing."""
    parts = [x for x in re.split(r"[\s_-]+", CAMEL.sub("-", token).lower()) if x]
    if not parts or parts[0] in WITHOUT:
        return None
    kinds = ["mark" if x in MARKS else "readers" if x in READERS else "body" if x in BODIES else None for x in parts]
    if parts[-1] in PLAIN and "body" in kinds and "mark" in kinds:
        return None
    return next((kind for part, kind in zip(reversed(parts), reversed(kinds), strict=True) if part not in PLAIN), None)


class Page:
    """Items in page order: (tag, None, 1 inside content elements) or ("", block, words); texts of blocks; runs of (names, words) of each block."""

    def __init__(self, html: str, lists: bool = True):
        self.lists = lists
        self.items: list[tuple[str, int | None, int]] = []
        self.blocks: list[str] = []
        self.runs: list[list[tuple[frozenset[str], int]]] = []
        self.articles: list[tuple[int, int]] = []
        self._parts: list[str] = []
        self._runs: list[tuple[frozenset[str], int]] = []
        self._read(html)

    def _close(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.items.append(("", len(self.blocks), text.count(" ") + 1))
            self.blocks.append(text)
            self.runs.append(self._runs)
        self._parts, self._runs = [], []

    def _names(self, name: str, rest: str, scope: frozenset[str]) -> tuple[frozenset[str], bool]:
        """Names around what the element holds, and whether it hides it."""
        if not rest.strip():
            marks = {}
        else:
            marks = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
        hides = name in UNSEEN or (bool(marks) and (marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", ""))) or (bool(rest) and bool(HIDDEN.search(QUOTED.sub("", rest))))
        inside = bool(scope & CONTENT)
        if name in CONTENT:
            if self.lists and not inside:
                scope = scope & {"readers"}
            return scope | {name}, hides
        own: set[str] = set()
        if name not in ("div", "span", "section", "html", "body", "center") and not (name == "header" and inside):
            own.add(name)
        if name in CONTAINERS and marks:
            for token in f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}".split():
                own.add(f".{token.lower()}")
                if self.lists and (kind := role_of(token)) and not (inside and name == "header"):
                    own.add(kind)
        own -= scope
        return (scope | own if own and len(scope) < MOST_NAMES else scope), hides

    def _read(self, html: str) -> None:
        at, hidden = 0, 0
        scope: frozenset[str] = frozenset()
        stack: list[tuple[str, bool, frozenset[str]]] = []  # element, hides, names outside it
        tops: list[int] = []  # places of blocks and cells in the stack
        opened: Counter = Counter()
        start: int | None = None

        def text(piece: str) -> None:
            if piece and not hidden:
                piece = unescape(piece)
                self._parts.append(piece)
                self._runs.append((scope, len(piece.split())))

        def leave(k: int) -> None:
            nonlocal hidden, scope
            while len(stack) > k:
                name, hides, scope = stack.pop()
                hidden -= hides
                opened[name] -= 1
            while tops and tops[-1] >= k:
                tops.pop()

        while at < len(html):
            m = ITEM.search(html, at)
            if m is None:
                text(html[at:])
                break
            text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            closing, name, rest = m[1], m[2].lower(), m[3]
            if name in BLOCKS:
                self._close()
            elif name in SPACED:
                self._parts.append(" ")
            if not hidden:
                self.items.append((f"/{name}" if closing else name, None, int(self.lists and bool(scope & CONTENT))))
            if closing:
                if name == "article" and start is not None:
                    self.articles.append((start, len(self.items)))
                    start = None
                if opened[name]:
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    leave(k)
                continue
            if name == "article" and start is None:
                start = len(self.items)
            if name in VOID or rest.rstrip().endswith("/"):
                continue
            if name in RAW:
                end = END[name].search(html, at)
                at = end.start() if end else len(html)
                at = html.find(">", at) + 1 or len(html)
                continue
            if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and tops and stack[tops[-1]][0] == name:  # an open one ends here
                leave(tops[-1])
            names, hides = self._names(name, rest, scope)
            if name in BLOCKS or name in ("td", "th", "option"):
                tops.append(len(stack))
            stack.append((name, hides, scope))
            opened[name] += 1
            hidden, scope = hidden + hides, names
        self._close()
        if start is not None:
            self.articles.append((start, len(self.items)))

    def scores(self, weights: Weights) -> list[tuple[float, bool]]:
        """Of each block: its score, and whether it lies in a content element."""
        out = []
        for runs in self.runs:
            total = sum(n for _, n in runs)
            mean = sum(weights.word(s) * n for s, n in runs) / total if total else weights.word(runs[0][0])
            out.append((max(-0.25, min(1.0, mean)), weights.lists and bool(runs[0][0] & CONTENT)))
        if any(inside and score > 0 for score, inside in out):
            beside = weights.names.get("beside", 0.0)
            out = [(score if inside else max(-0.25, min(1.0, score + beside)), inside) for score, inside in out]
        return out

    def best(self, values: list[float]) -> tuple[int, int]:
        """Bounds of the run of items with the largest sum, by a linear scan."""
        top, total, start, out = 0.0, 0.0, 0, (0, 0)
        for k, value in enumerate(values):
            if total <= 0:
                total, start = 0.0, k
            total += value
            if total > top:
                top, out = total, (start, k + 1)
        return out

    def values(self, weights: Weights, scored: list[tuple[float, bool]]) -> list[float]:
        """A number for each item. Inside a content element tags cost least and boilerplate, which is left out, nothing, so they don't split it."""
        out = []
        for tag, block, n in self.items:
            if block is None:
                out.append(-0.05 if n else weights.tag(tag))
            else:
                score, inside = scored[block]
                out.append(0.0 if inside and score < 0 else score * n)
        return out

    def text(self, weights: Weights) -> str:
        scored = self.scores(weights)
        a, z = self.best(self.values(weights, scored))
        return "\n".join(self.blocks[k] for _, k, _ in self.items[a:z] if k is not None and scored[k][0] > 0)


Seen = tuple[Counter, Counter]


def counts(html: str, lists: bool = True) -> Seen | None:
    """Words by (names, in content) and tags by (tag, in content) of a page that labels its content by one article element."""
    page = Page(html, lists)
    if len(page.articles) != 1:
        return None
    a, z = page.articles[0]
    words: Counter = Counter()
    tags: Counter = Counter()
    for k, (tag, block, _) in enumerate(page.items):
        if block is None:
            tags[tag, a <= k < z] += 1
        else:
            for names, n in page.runs[block]:
                words["\t".join(sorted(names - CONTENT)), a <= k < z] += n
    return words, tags


def learn(words: Counter, tags: Counter, prior: Prior = PRIOR) -> Weights:
    """Logistic regression for words, by Newton steps one weight at a time; log odds for tags, never above -0.05."""
    rows = sorted({s for s, _ in words})
    if not rows:
        return unlearned(prior)
    names = [frozenset(s.split("\t")) - {""} for s in rows]
    inside, outside = ([math.log2(1 + words[s, side]) for s in rows] for side in (True, False))
    having: dict[str, list[int]] = {}
    for k, found in enumerate(names):
        for x in found:
            having.setdefault(x, []).append(k)
    weight = {x: prior.names.get(x, 0.0) for x in sorted(having)}
    start = prior.start
    score = [start + sum(weight[x] for x in found) for found in names]

    def step(of: list[int], now: float, mean: float, variance: float) -> float:
        pull, bend = (now - mean) / variance, 1 / variance
        for k in of:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score[k]))))
            pull += (inside[k] + outside[k]) * p - inside[k]
            bend += (inside[k] + outside[k]) * p * (1 - p)
        move = max(-1.0, min(1.0, -pull / bend))
        for k in of:
            score[k] += move
        return move

    for _ in range(60):
        most = abs(move := step(list(range(len(rows))), start, prior.start, 1.0))
        start += move
        for x, of in having.items():
            move = step(of, weight[x], prior.names.get(x, 0.0), prior.variance(x))
            weight[x] += move
            most = max(most, abs(move))
        if most < 1e-4:
            break
    totals = [sum(n for (_, side), n in tags.items() if side is where) + 1 for where in (False, True)]
    odds = {t: math.log((tags[t, True] + 0.5) / totals[1]) - math.log((tags[t, False] + 0.5) / totals[0]) for t in {t for t, _ in tags}}
    least = {t: -0.5 if t.strip("/") in prior.firm else -3.0 for t in odds}
    return Weights(prior.names | weight, {t: max(least[t], min(-0.05, x)) for t, x in odds.items()}, start, prior.lists)


def _rows(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))


def fit(pages: DataFrame, most: int = 512, seed: int = 5, prior: Prior = PRIOR, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> Weights:
    """Weights from at most ``most`` labelled pages."""
    labelled = _rows(pages, id_col, html_col, url_col).filter("lower(html) like '%<article%'")
    at = F.xxhash64("id", F.xxhash64("html"), F.lit(seed))
    least = labelled.select(at.alias("at")).distinct().orderBy("at").limit(most)
    sample = labelled.withColumn("at", at).join(F.broadcast(least), "at").dropDuplicates(["at"])  # at most `most` pages
    lists = prior.lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        tags: Counter = Counter()
        for b in batches:
            for html in b.column("html").to_pylist():
                for total, got in zip((words, tags), counts(html, lists) or ({}, {}), strict=True):
                    total.update(got)
        rows = [(name, inside, n, tag) for tag, total in ((False, words), (True, tags)) for (name, inside), n in total.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.bool_()), strict=True)], names=["name", "inside", "n", "tag"])

    summed = map_batches(sample.select("html"), run, "name string, inside boolean, n long, tag boolean").groupBy("tag", "name", "inside").agg(F.sum("n").alias("n"))
    words: Counter = Counter()
    tags: Counter = Counter()
    for r in summed.collect():  # names and tags of at most `most` pages
        (tags if r["tag"] else words)[r["name"], r["inside"]] = r["n"]
    return learn(words, tags, prior)


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Page(html, weights.lists).text(weights) if html else "" for html in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(got, pa.string())], names=["id", "url", "text"])

    return map_batches(_rows(pages, id_col, html_col, url_col), run, "id long, url string, text string")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages)).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
