import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cases import byte_digest, covered_bytes, near_components  # noqa: E402

from edgelight.llm.common import documents, staged  # noqa: E402


def test_stages(spark, small):
    docs = documents(spark, small)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    clean = staged(stages["toxicity"](spark, docs, small))
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    right = [(k in kept) == (not y) for k, y in truth.items()]
    assert clean.columns == columns and sum(right) / len(right) > 0.85
    single = staged(stages["near_dedup"](spark, clean, small))
    want = near_components(sorted(kept.items()))
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == columns and set(left) == {k for k, (_, c) in want.items() if c == k}
    cut = staged(stages["suffix_array_dedup"](spark, single, small))
    rows = sorted(left.items())
    for (k, t), (b, gone) in zip(rows, covered_bytes(rows), strict=True):
        left[k] = (t, byte_digest(b, gone)[1])
    assert cut.columns == columns
    for r in cut.collect():
        t, removed = left.pop(r["doc_id"])
        assert 0 <= removed - (len(t.encode()) - len(r["text"].encode())) <= 6 * (removed > 0) * max(1, t.count("\n") + 9)
        assert r["n_chars"] == len(r["text"])
    assert all(removed > 0 for _, removed in left.values())
    mixed = staged(stages["source_mix"](spark, cut, small))
    assert mixed.columns == columns and mixed.count() > 0
    packed = stages["packing"](spark, mixed, small)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_run_is_its_stages_one_after_the_other(spark, small):
    docs = documents(spark, small)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small))
    out = corpus_pipeline.run(spark, small)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_empty_documents(spark, small):
    docs = documents(spark, small).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small))
    assert docs.count() == 0
