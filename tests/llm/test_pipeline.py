"""The corpus pipeline, stage by stage and as a whole."""

from collections import Counter

import pytest

import corpus_pipeline
from barloom.llm import bpe, mixing, quality_classifier, quality_rules, simhash_dedup


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{top}/{k}")
        got = spark.read.parquet(f"{top}/{k}")
        out.append((docs, got))
        docs = got
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(got.columns == columns for _, got in stages[:-1])


def test_each_stage_does_what_its_operator_says(stages, spark, sf):
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages
    assert ids(b) == {r["id"] for r in quality_rules.rated(a).filter("kept").collect()} and b.count() == len(ids(b))
    model = quality_classifier.fit(a, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(c) == {r["id"] for r in quality_classifier.score(b, model).filter("score >= 0.5").collect()}
    marks = {r["doc_id"]: tuple(simhash_dedup.fingerprint(r["text"], n) for n in (3, 5)) for r in c.collect()}
    group = {m: m for m in marks.values()}
    near = lambda x, y: (x[0] ^ y[0]).bit_count() <= 9 and (x[1] ^ y[1]).bit_count() <= 12
    while (joined := {m: min(g for n, g in group.items() if near(m, n)) for m in group}) != group:
        group = joined
    least = {}
    for i in sorted(marks):
        least.setdefault(group[marks[i]], i)
    assert ids(d) == set(least.values()) and d.count() == len(ids(d))
    taken, whole = Counter(), {r["doc_id"]: r["text"] for r in d.collect()}
    for r in e.collect():
        taken[r["doc_id"]] += len(r["text"].encode().split())
        assert whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert taken == +Counter({r["id"]: r["taken"] for r in mixing.taken(mixing.mix(d)).collect()})
    enc = bpe.Encoder(bpe.default_path())
    want = Counter((r["doc_id"], enc.encode(r["text"])[1]) for r in e.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in f.collect()) == want


def test_run_gives_the_last_stage(stages, spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in stages[-1][1].collect())
