import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from cases import SCHEMA, byte_digest, covered_bytes, frame, near_components, prose, table, word_digests
from pyspark.sql import functions as F

from edgelight.llm import near_dup, repeats, suffix_array, suffix_tree
from edgelight.llm.common import connected_components


def by_row(frame, columns):
    return sorted((repr(r["doc_id"]), repr(r["text"]), *(r[c] for c in columns)) for r in frame.collect())


def known(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def test_near_duplicates(spark):
    rows = {r[0]: r for r in table() if r[0] is not None and r[0] != 18}
    rows = list(rows.values()) + [r for r in table() if r[0] == 18][:1]
    want = near_components([(r[0], r[1]) for r in rows])
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_near_duplicates_keeps_every_row(spark):
    out = near_dup.near_duplicates(frame(spark)).collect()
    assert len(out) == len(table())
    assert sorted(repr(r["component"]) for r in out if r["id"] is None) == ["None", "None"]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_clusters_of_near_copies_are_joined_across_leaders(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng, base, rows = random.Random(5), prose(120, 9).split(" "), []
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(120), rng.randrange(1, 8)):
            own[j] = f"own{i}x{j}"
        rows.append((i, " ".join(own), "en", "a", 1))
    want = near_components([(r[0], r[1]) for r in rows])
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) < 60


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for j in (0.75, 0.9):
        n = 2000
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        shared = int(2 * n * j / (1 + j))
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared).astype(np.uint64)])
        x, y = (np.frombuffer(near_dup.odd_sketch(near_dup.minhash(s)), np.uint64) for s in (a, b))
        flips = int(np.bitwise_count(x ^ y).sum())
        assert flips <= near_dup.most_flips(0.75)
        estimate = 1 + near_dup.SKETCH_BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * flips / near_dup.SKETCH_BITS)
        assert abs(estimate - j) < 0.15


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in {x for e in links for x in e} | {999}], "node long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 40 else 100 if n < 200 else 999 for n in got}


def test_suffix_array_dedup(spark):
    rows = [r for r in table() if r[0] is not None]
    want = sorted((repr(k), repr(t), *byte_digest(*x)) for (k, t), x in zip(known(rows), covered_bytes(known(rows)), strict=True))
    out = suffix_array.dedup_bytes(frame(spark), whole_characters=False).where("doc_id is not null")
    got = []
    for r in out.collect():
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for s in r["removed"]:
            gone[s["begin"] : s["end"]] = b"\1" * (s["end"] - s["begin"])
        got.append((repr(r["doc_id"]), repr(r["text"]), *byte_digest(data, gone)))
    assert sorted(got) == want


def test_whole_characters_stay(spark):
    out = suffix_array.dedup_bytes(frame(spark)).collect()
    assert len(out) == len(table())
    for r in out:
        assert (r["kept_text"] is None) == (r["text"] is None)
        if r["text"] is not None:
            data = r["text"].encode()
            edge = [0, *(x for s in r["removed"] for x in (s["begin"], s["end"])), len(data)]
            assert b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)).decode() == r["kept_text"]
    assert suffix_array.dedup_bytes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bucket_refinement_finds_equal_windows(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(97, 99, rng.integers(0, 90)).astype(np.uint8) for _ in range(40)] + [np.full(60, 97, np.uint8)] * 2
    data = np.concatenate([np.append(s, 10) for s in strings]).astype(np.uint8)
    offsets = np.cumsum([0, *(len(s) + 1 for s in strings)])
    if seed % 2:
        monkeypatch.setattr(suffix_array, "CHUNK", 5)
    for width in (3, 5, 13, 50):
        starts, first = suffix_array.equal_windows(data, offsets, width)
        groups = {}
        for a, b in zip(offsets[:-1], offsets[1:] - 1, strict=True):
            for i in range(a, b - width + 1):
                groups.setdefault(bytes(data[i : i + width]), set()).add(i)
        want = sorted(sorted(g) for g in groups.values())
        assert sorted(sorted(x.tolist()) for x in np.split(starts, first[1:]) if len(x)) == want


@pytest.mark.parametrize("limit", [3, 20, 1 << 16])
def test_deep_nodes_are_maximal_repeats(limit):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        strings = [rng.integers(1, 2 + rng.integers(1, 5), rng.integers(0, 90)) for _ in range(30)] + [np.full(60, 1)] * 2
        words, bounds = np.concatenate(strings), np.cumsum([0, *map(len, strings)])
        for width in (1, 5, 13, 35):
            groups = {}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i in range(a, b - width + 1):
                    groups.setdefault(tuple(words[i : i + width]), []).append((i, b))
            want = []
            for g in groups.values():
                depth = width
                while len(g) > 1 and all(i + depth < b for i, b in g) and len({words[i + depth] for i, b in g}) == 1:
                    depth += 1
                if len(g) > 1:
                    want.append((sorted(i for i, _ in g), depth))
            got = [(sorted(x.tolist()), d) for s, first, depths in suffix_tree.deep_nodes(words, bounds, width, limit) for x, d in zip(np.split(s, first[1:]), depths.tolist(), strict=False) if len(x)]
            assert sorted(got) == sorted(want)


def test_prefixes_are_lengthened_where_groups_are_large():
    words = np.concatenate([np.tile([1, 2, 3], 200), np.arange(4, 300)])
    suffix = np.arange(len(words) - 40)
    groups = list(suffix_tree.prefix_groups(words, suffix, 0, 35, 64))
    assert sorted(np.concatenate([s for s, _, _ in groups])) == suffix.tolist()
    assert {d for _, _, d in groups} >= {1, 35} and all(len(s) <= 64 or d == 35 for s, _, d in groups)
    for s, number, depth in groups:
        assert len({(n, *words[i : i + depth]) for i, n in zip(s, number, strict=True)}) == len(set(number.tolist()))


def test_query_columns_of_op3(spark):
    rows = [r for r in table() if r[0] is not None]
    want = sorted((k, *byte_digest(*x)) for (k, _), x in zip(known(rows), covered_bytes(known(rows)), strict=True))
    out = suffix_array.digests(frame(spark)).where("doc_id is not null")
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def test_suffix_tree_dedup(spark):
    rows = [r for r in table() if r[0] is not None]
    want = sorted((repr(k), repr(t), *d) for (k, t), d in zip(known(rows), word_digests(known(rows)), strict=True))
    out = suffix_tree.dedup_words(frame(spark)).where("doc_id is not null").withColumn("digest", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert by_row(out, ["n_words", "n_removed", "digest"]) == want
    assert suffix_tree.dedup_words(frame(spark, [])).count() == 0


@pytest.mark.parametrize("kind", [repeats.Kind(False, 50, 16, True), repeats.Kind(True, 35, 8, False)])
def test_hot_passages_are_spread_and_still_found(spark, monkeypatch, kind):
    monkeypatch.setattr(repeats, "HOT_LEAST", 3)
    passage = prose(90, 21)
    rows = [(i, f"{prose(20, i)} {passage} {prose(20, 1000 + i)}", "en", "a", 1) for i in range(30)]
    if kind.words:
        out = suffix_tree.dedup_words(frame(spark, rows)).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_removed"]) for r in out] == [d[:2] for d in word_digests(known(rows))]
    else:
        out = suffix_array.dedup_bytes(frame(spark, rows)).orderBy("doc_id").collect()
        assert [sum(s["end"] - s["begin"] for s in r["removed"]) for r in out] == [sum(g) for _, g in covered_bytes(known(rows))]


@pytest.mark.parametrize("kind", [repeats.Kind(False, 50, 16, True), repeats.Kind(True, 35, 8, False)])
def test_only_the_array_and_the_tree_decide(spark, kind):
    none = (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    assert repeats.repeated_windows(frame(spark), kind, lambda entries: none, "doc_id", "text").count() == 0


def test_equal_strings_are_told_by_their_owners():
    words, bounds = np.tile(np.arange(1, 41), 2), np.array([0, 40, 80])
    words[40:] += np.where(np.arange(40) < 3, 100, 0)  # the second string shares all but the first three words
    entries = repeats.Entries(np.zeros(2, np.uint8), np.full(2, 6), np.array([5, 3]), np.array([9, 3]), np.array([2, 1]), words, bounds)
    runs = sorted(zip(*(c.tolist() for c in suffix_tree.repeated_anywhere(35)(entries)), strict=True))
    assert runs == [(0, 0, 6, True), (1, 3, 3, True)]
    text = np.frombuffer((words + 30).astype(np.uint8).tobytes(), np.uint8)
    runs = sorted(zip(*(c.tolist() for c in suffix_array.earlier_elsewhere(35)(repeats.Entries(entries.part, entries.windows, entries.least, entries.most, entries.owners, text, bounds))), strict=True))
    assert runs == [(0, 0, 3, False), (0, 3, 3, True)]


@pytest.mark.parametrize("kind", [repeats.Kind(False, 50, 16, True), repeats.Kind(True, 35, 8, False)])
def test_what_a_batch_knows_of_copies_is_short_and_spread(kind):
    text, buckets = prose(400, 22).encode(), 64
    uids = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, 200)
    ids, texts = pa.array(np.arange(200)), pa.array([text] * 200, pa.binary())
    (marked,) = repeats.anchor_rows(kind, buckets)([pa.RecordBatch.from_arrays([pa.array(uids), texts], names=["uid", "text"])])
    rows = [r for r in marked.to_pylist() if r["tag"] == 1]
    assert {r["id"] for r in rows} == set(uids.tolist()) and pd.Series([r["key"] for r in rows]).value_counts().max() < 20
    packed, none = pa.array([[r["blob"]] for r in rows[:1]] + [[]] * 199, pa.list_(pa.binary())), pa.array([[]] * 200, pa.list_(pa.int64()))
    finder = suffix_tree.repeated_anywhere(kind.width) if kind.words else suffix_array.earlier_elsewhere(kind.width)
    moved = repeats.fragment_rows(kind, buckets, np.zeros(0, np.uint64), finder)([pa.RecordBatch.from_arrays([pa.array(uids), texts, none, packed, ids], names=["uid", "text", "shared", "packed", "id"])])
    rows = [r for batch in moved for r in batch.to_pylist() if r["spans"] is not None]
    n = (400 if kind.words else len(text)) - kind.width + 1
    assert {r["id"] for r in rows} == set(range(kind.earlier, 200)) and pd.Series([r["key"] for r in rows]).value_counts().max() < 20
    assert all(np.frombuffer(r["spans"], "<i8").tolist() == [0, n] for r in rows)


def test_clashing_columns(spark):
    wide = frame(spark).selectExpr("*", "1 as uid", "2 as spans", "3 as _spans", "4 as of", "5 as id", "6 as key", "7 as _cut", "8 as _uid")
    assert suffix_array.dedup_bytes(wide).columns[:-2] == wide.columns
    assert suffix_tree.dedup_words(wide).count() == len(table())
    assert near_dup.near_duplicates(wide).count() == len(table())
    assert pd.Series(SCHEMA.split(",")).size == 5
