"""Each operator and each stage on tables that are made to break it: clashing names, nulls, shared ids, repeats, one very long text, nothing."""

import pytest
from cases import SCHEMA, prose
from pyspark.sql import functions as F

from edgelight.llm import lattice, mixing, near_dup, order_minhash, packing, sharding, suffix_array, suffix_tree, tool_calls, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Names that operators use for columns, inside or in what they return.
NAMES = """uid spans _spans of id key _cut _uid _of _id _key _nth _keeper kept_id kept_text removed n_words n_removed target source_size _mix_whole _mix_size
mix_size mix_taken _copy _partial _hash _bucket _start row_number position shard slot size text_crc32 fingerprint bucket ghost next_text p_toxic is_toxic p_low_quality
is_low_quality _scores _class _text component keeper n_shingles start length offset sequence_id vector cells least copies run blob tag depth seq status errors message""".split()

LONG = prose(40_000, 31, 100_000)
ROWS = [
    (1, None, "en", "a", 1), (2, "", "en", None, 1), (3, " \t\n", "en", "a", 1), (4, LONG, "en", "a", 1), (4, prose(80, 32), "en", "b", 1), (5, LONG[:9000], "en", "b", 1),
    (6, prose(80, 32), "en", None, 1), (6, prose(80, 32), "en", None, 1), (None, prose(80, 32), "en", "a", 1), (None, None, None, None, None), (7, "😀 ünï 日本 " * 30, "en", "c", 1),
]


def clashing(frame):
    return frame.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in frame.columns])


def documents(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


def chain(docs):
    labels = clashing(docs.select("doc_id").distinct()).withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    return toxicity.score(docs, toxicity.fit(docs, labels, toxicity.categories()))


KEEPS_COLUMNS = {
    "suffix_array": suffix_array.dedup_bytes,
    "suffix_tree": suffix_tree.dedup_words,
    "toxicity": chain,
    "mixing": mixing.mix,
    "order_minhash": order_minhash.order_minhash,
}
OWN_COLUMNS = {
    "sharding": sharding.shard,
    "near_dup": near_dup.near_duplicates,
    "order_minhash_next": lambda d: order_minhash.with_next(d, "doc_id", "text", 4).where("not ghost"),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).where("start = 0"),
}


def own_values(frame):
    columns = ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
    return sorted(map(repr, frame.select(*columns).collect()))


@pytest.mark.parametrize("name", KEEPS_COLUMNS)
def test_all_columns_stay_as_they_are(spark, name):
    docs = documents(spark, ROWS)
    out = KEEPS_COLUMNS[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns)
    assert own_values(out) == own_values(docs)
    assert KEEPS_COLUMNS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", OWN_COLUMNS)
def test_every_row_has_a_result(spark, name):
    assert len(OWN_COLUMNS[name](documents(spark, ROWS)).collect()) == len(ROWS)
    assert OWN_COLUMNS[name](documents(spark, [])).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (None, [1.0, 0.0]), (8, None), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0])]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(repr, (tuple(r) for r in lattice.vector_components(frame).collect())))
    assert got == sorted(map(repr, [(5, 2, 1), (5, 0, 5), (1, 2, 1), (2, 2, 1), (None, 0, None), (8, 0, 8), (8, 0, 8), (9, 0, 9), (7, 1, 7), (7, 1, 7)]))
    assert lattice.vector_components(frame.limit(0)).count() == 0


def test_tool_calls_with_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "a", 0, "t", "{}", None), (1, None, 1, "t", "{", "a"), (None, "a", 2, None, None, None), (1, "a", 0, "t", "{}", None)], "conv_id long, call_id string, turn int, name string, arguments string, parent_id string")
    results = spark.createDataFrame([(1, "a", 3, LONG), (1, None, 4, "x"), (1, "a", 3, LONG)], "conv_id long, call_id string, turn int, content string")
    out = tool_calls.link_tool_calls(clashing(calls), clashing(results), {"t": {}}).collect()
    assert [r["message"] for r in out if '"raw_arguments":"{"' in r["message"]] and all('"raw_arguments"' not in r["message"] for r in out if r["call_id"] == "a")
    assert sorted(r["status"] for r in out) == ["duplicate_call", "no_result", "no_result", "ok", "orphan_result", "orphan_result"]
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_stages_keep_clashing_columns(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, ROWS)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*NAMES).distinct().collect()} == {tuple(f"own {n}" for n in NAMES)}
    assert pipeline.STAGES[-1][1](spark, docs, small).where("start = 0").count() == len(ROWS)
