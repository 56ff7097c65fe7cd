import json
import zlib
from decimal import Decimal

import numpy as np
import pytest
from cases import frame, prose, table, words
from pyspark.sql import functions as F

from edgelight.llm import lattice, mixing, order_minhash, packing, queries, sharding, tool_calls, toxicity

VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# ---- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n, 5)
    assert sorted(image) == list(range(n))
    assert (image == sharding.permute(np.arange(n), n, 5)).all()
    assert n < 17 or (image != sharding.permute(np.arange(n), n, 6)).any()


def test_shards(spark):
    rows = sharding.shard(frame(spark), shards=4).collect()
    assert len(rows) == len(table())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(4)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((repr(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in table())
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    again = sharding.shard(frame(spark).repartition(7), shards=4)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    assert sharding.shard(frame(spark, [])).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------------------------


def filled(sizes, weights, total, cap):
    """Clamp and share anew until no target is above its cap."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * share >= cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = weights[i] * share
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        free -= over
    return target


def test_mix(spark):
    rows = mixing.mix(frame(spark)).collect()
    assert len(rows) == len(table())
    sizes = {}
    for r in table():
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, filled([sizes[s] for s in order], [mixing.CYCLE[i % 3] for i in range(len(order))], sum(sizes.values()), 3), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in rows:
        assert r["mix_size"] == len(words(r["text"])) and r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(want[r["source"]]) and 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mix_as_rows(spark):
    mixed = mixing.mix(frame(spark))
    out = mixing.repeated(mixed).collect()
    assert sum(len(words(r["text"])) for r in out) == mixed.agg(F.sum("mix_taken")).first()[0]
    assert all(r["n_chars"] == len(r["text"] or "") for r in out if r["doc_id"] not in (18, None))
    originals = {t[1] for t in table()}
    assert all(r["text"] in originals or any((o or "").startswith(r["text"]) for o in originals) for r in out)


def test_water_fill_clamps(spark):
    sizes, weights = [1, 100, 1000, 0], [50.0, 1.0, 1.0, 5.0]
    sources = spark.createDataFrame(list(zip(sizes, weights, strict=True)), "source_size long, weight double")
    got = [r["target"] for r in mixing.water_fill(sources, 1101.0, 3).orderBy("source_size").collect()]
    want = filled(sizes, weights, 1101.0, 3)
    assert got == pytest.approx([want[3], want[0], want[1], want[2]])


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_cuts_are_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        cost = rng.integers(0, 9, len(points))
        best, back = [0] + [10**9] * (len(points) - 1), [0] * len(points)
        for j in range(1, len(points)):
            for i in range(j):
                if points[j] - points[i] <= 10 and best[i] + 10 - (points[j] - points[i]) + cost[j] < best[j]:
                    best[j], back[j] = best[i] + 10 - (points[j] - points[i]) + cost[j], i
        cuts = packing.cut(points, cost, 10)
        assert cuts[-1] == points[-1] and np.diff([0, *cuts]).max() <= 10
        price = dict(zip(points.tolist(), cost.tolist(), strict=True))
        assert sum(10 - (b - a) + price[b] for a, b in zip([0, *cuts], cuts, strict=False)) == best[-1]


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(VOCABULARY)
    rows = [*table(), (500, "a<|endoftext|>b", "en", "a", 1)]
    pieces = packing.pack(frame(spark, rows), VOCABULARY).collect()
    by_row = {}
    sequences = {}
    for p in pieces:
        by_row.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for (k, n), own in by_row.items():
        ids = [np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t, *_ in rows if d == k]
        ids = [x for x in ids if len(x) == n]
        got = sorted((p["start"], p["length"], p["ids_crc32"]) for p in own)
        want = sorted((p["start"], p["length"], zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes())) for x in ids[:1] for p in own)
        assert got == want and sum(p["length"] for p in own) == n * len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0


def test_little_padding():
    packer, texts = packing.Packer(packing.Tokens(VOCABULARY), 512, 1, 0), [prose(n, n) + "." for n in range(1, 300, 3)]
    pieces = [p for i, t in enumerate(texts) for p in packer.add(i, t)] + list(packer.plan(last=True))
    full = sum(p[2] for p in pieces)
    assert full / len({p[5] for p in pieces}) > 0.8 * 512


# ---- toxicity --------------------------------------------------------------------------------------------------------


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic, poor = int(rng.random() < 0.2), int(rng.random() < 0.3)
        text = prose(60, int(seed * 10_000 + i)) + (" vile scum" if toxic else "") + (" lorem lorem" if poor else "")
        rows.append((i, text, 1 - poor, toxic))
    return rows


def test_chain_on_held_out_texts(spark):
    train, held = labelled(400, 1), labelled(200, 2)
    docs = spark.createDataFrame([r[:2] for r in train] + [(9999, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in train] + [(None, 1, 1), (9999, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.categories())
    scored = toxicity.score(spark.createDataFrame([(r[0], r[1]) for r in held] + [(-1, None), (-2, "")], "doc_id long, text string"), chain).collect()
    truth = {r[0]: r for r in held}
    right = sum(r["is_toxic"] == bool(truth[r["doc_id"]][3]) for r in scored if r["doc_id"] >= 0)
    assert right / len(held) > 0.97
    assert all(r["p_toxic"] == 0 and not r["is_toxic"] for r in scored if r["doc_id"] < 0)


def test_unknown_words_leave_a_feature_row_alone():
    rng = np.random.default_rng(7)
    vocabulary, known = np.array([10, 20, 4_000_000_000], np.uint32), np.array([20, 4_000_000_000], np.uint32)
    unknown = [np.array([15, 12, 4_000_000_001], np.uint32), rng.integers(21, 4_000_000_000, 3000).astype(np.uint32)]
    lists = [known, *[rng.permutation(np.concatenate([known, u])) for u in unknown], unknown[0], np.array([20, 20], np.uint32), known[:0]]
    x = toxicity.Rows.of(lists, vocabulary, np.ones((len(lists), 1)))
    assert [x.ids[a:b].tolist() for a, b in zip(x.starts[:-1], x.starts[1:], strict=True)] == [[1, 2], [1, 2], [1, 2], [], [1], []]


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none, toxicity.categories())).count() == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none, toxicity.categories())).count() == 0


def test_a_later_category_learns_from_what_the_earlier_says_of_unseen_rows(monkeypatch):
    """The second model is fitted beside the out-of-fold probabilities of the first, not those of the rows it was fitted on, and scores with its probabilities."""
    rng, seen = np.random.default_rng(8), []
    lists = [np.unique(rng.integers(0, 60, 12)).astype(np.uint32) for _ in range(300)]
    y0 = np.array([float((x < 8).sum() >= 2) for x in lists])
    y1 = np.where(rng.random(300) < 0.97, y0, 1 - y0)
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, y, w: seen.append((len(y), np.array(x.dense))) or fit(x, y, w))
    chain = toxicity.fit_chain(lists, {"first": y0, "second": y1}, np.ones(300))
    whole = [dense for n, dense in seen if n == 300]
    assert whole[0].shape == (300, 1) and whole[1].shape == (300, 2)
    assert np.array_equal(whole[1][:, 0], chain.out_of_fold[0])
    x = toxicity.Rows.of(lists, chain.vocabulary, np.ones((300, 1)))
    fitted = toxicity.sigmoid(x.times(chain.coefficients[0]))
    assert np.abs(fitted - chain.out_of_fold[0]).max() > 0.01  # not what the first model says of its own rows
    x.dense = np.column_stack([fitted, np.ones(300)])
    with_first = toxicity.sigmoid(x.times(chain.coefficients[1]))
    x.dense = np.column_stack([1 - fitted, np.ones(300)])
    assert np.corrcoef(fitted, with_first)[0, 1] > 0.5 and np.abs(toxicity.sigmoid(x.times(chain.coefficients[1])) - with_first).max() > 0.1


def test_out_of_fold_rows_are_not_seen_by_their_model():
    # The label of a text is chance, and each text comes thirty times: only a model that has seen a copy of it can tell its label.
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 1 << 32, 30).astype(np.uint32) for _ in range(40)]
    y = np.repeat(rng.permutation(np.arange(40) % 2), 30).astype(float)
    chain = toxicity.fit_chain([rng.permutation(t) for t in texts for _ in range(30)], {"toxic": y}, np.ones(1200))
    p = chain.out_of_fold[0].reshape(40, 30)
    assert np.ptp(p, axis=1).max() < 1e-9
    assert ((p > 0.5) == (y.reshape(40, 30) > 0.5)).mean() < 0.7


@pytest.mark.parametrize("labels", [[], [(77, 1, 1)], [(1, None, 1), (2, None, 0)], [(1, 0, 1), (2, 0, 1)], [(1, 1, 0), (2, 1, 0)]])
def test_nothing_is_toxic_without_labels_of_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "some text"), (2, "more of it"), (3, None)], "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.categories())
    scored = toxicity.score(docs, chain).collect()
    assert len(scored) == 3 and not any(r["is_toxic"] or r["is_low_quality"] for r in scored)
    assert all(r["is_toxic"] is False and 0 <= r["p_toxic"] <= 1 for r in scored)


# ---- vectors ---------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + 0.03 * rng.normal(size=64)).tolist()) for i in range(60)] + [(200, base[7].tolist()), (201, (base[7] * 3).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 64), (303, [float("nan")] * 64), (304, [None, 1.0]), (305, [float("inf")] * 64), (306, [1.0, 2.0]), (None, base[0].tolist())]
    x = {k: np.array(v) for k, v in rows if k is not None and (k < 300)}
    unit = {k: v / np.linalg.norm(v) for k, v in x.items()}
    links = {k: {j for j in x if j != k and unit[k] @ unit[j] >= 0.9} for k in x}
    got = {r["id"]: (r["n_links"], r["component"]) for r in lattice.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k in x:
        near = {k}
        while True:
            more = near | {j for n in near for j in links[n]}
            if more == near:
                break
            near = more
        assert got[k] == (len(links[k]), min(near))
    assert all(got[k] == (0, k) for k in (300, 301, 302, 303, 304, 305, 306, None))
    assert lattice.vector_components(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def turned(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return cosine * x + np.sqrt(1 - cosine**2) * z


def meet(x, y, dimensions, pairs):
    """Whether one looks into the other's cell in any table: row by row, or each row of x with each of y."""
    direction, shift = lattice.projections(dimensions, lattice.TABLES)
    met = np.zeros(len(x) if pairs else (len(x), len(y)), bool)
    for t in range(lattice.TABLES):
        a, b = (lattice.cells(v, direction[t], shift[t], lattice.edge(dimensions), lattice.PROBES, t) for v in (x, y))
        for p in range(lattice.PROBES):
            met |= (a[:, p] == b[:, 0]) | (a[:, 0] == b[:, p]) if pairs else (a[:, p][:, None] == b[:, 0][None]) | (a[:, 0][:, None] == b[:, p][None])
    return met


@pytest.mark.parametrize("dimensions", [2, 4, 8, 12, 16, 32, 64, 128, 384, 768, 1536])
def test_recall_at_the_threshold_and_unrelated_pairs(dimensions):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, dimensions))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert meet(x, turned(rng, x, 0.9), dimensions, True).mean() > 0.98
    if dimensions >= 8:  # below, a good part of all pairs is near
        far = meet(x[:400], x[400:], dimensions, False)[x[:400] @ x[400:].T < 0.9]
        assert far.mean() < (0.01 if dimensions > 8 else 0.02)


@pytest.mark.parametrize("dimensions", [16, 384])
def test_links_in_other_dimensions(spark, dimensions):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, dimensions))
    x /= np.linalg.norm(x, axis=1)[:, None]
    both = np.concatenate([x, turned(rng, x, 0.92)])
    links = ((both @ both.T) >= 0.9).sum() - len(both)
    got = lattice.vector_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>"))
    assert links * 0.98 <= got.agg({"n_links": "sum"}).first()[0] <= links


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(5).normal(size=(200, 8)) * 2
    point = lattice.nearest_e8(x)
    d = ((x - point) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()
    for v in lattice.NEIGHBOURS:
        assert (d <= ((x - point - v) ** 2).sum(axis=1) + 1e-9).all()


# ---- Order MinHash ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """The same fingerprint the long way: each ordering sorts all k-mers anew."""
    import re

    import xxhash

    def hashed(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    words = [hashed(w.encode()).to_bytes(8, "little") for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    k = order_minhash.K
    grams = [hashed(*words[i : i + k]).to_bytes(8, "little") for i in range(max(1, len(words) - k + 1))] if words else []
    seen, ranks = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        ranks.append((hashed(g, seen[g].to_bytes(4, "little")) ^ 1 << 63) >> order_minhash.POSITION_BITS)
    bits = 64 - order_minhash.POSITION_BITS
    out = []
    for t in range(order_minhash.TUPLES):
        circle, begin = t // order_minhash.POINTS, (t % order_minhash.POINTS) << (bits - order_minhash.ARC_BITS)
        own = ranks
        if circle:
            signed = [(r - (1 << (bits - 1))).to_bytes(8, "little", signed=True) for r in ranks]
            own = [(hashed(x, circle.to_bytes(4, "little")) ^ 1 << 63) >> order_minhash.POSITION_BITS for x in signed]
        smallest = sorted(range(len(grams)), key=lambda i: ((own[i] - begin) % (1 << bits), i))[: order_minhash.MEMBERS]
        out.append(hashed(*[grams[i] for i in sorted(smallest)]) % 16**order_minhash.DIGITS if grams else None)
    return out


def test_fingerprints_equal_brute_force(spark):
    repeated = "a b c d a b c d a b c d e a b c d"
    texts = [prose(400, 31), prose(30, 33), repeated, " ".join([repeated] * 40), "x " * 500, "one", "one two three four", "one two three four five", " \t\n", "", None, "üé 😀 z y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in order_minhash.order_minhash(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_likeness_is_that_of_independent_orderings():
    """Orderings that share four circles of ranks estimate what orderings of their own would: means over 40 pairs of texts."""
    rng = np.random.default_rng(5)
    shared, own = [], []
    for n in (12, 60, 300, 2000):
        for _ in range(10):
            words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
            other = list(words)
            for at in rng.integers(0, n, max(1, n // 40)):
                other[at] = f"v{at}"
            cut = n // 3
            other = other[cut:] + other[:cut]
            a, b = plain_fingerprint(" ".join(words)), plain_fingerprint(" ".join(other))
            shared.append(np.mean([x == y for x, y in zip(a, b, strict=True)]))
            grams = [[tuple(w[i : i + 4]) for i in range(n - 3)] for w in (words, other)]
            agree = 0
            orderings = 640 if n <= 60 else 64
            for _ in range(orderings):
                rank = {g: rng.random() for g in sorted(set(grams[0]) | set(grams[1]))}
                first, second = ([g[i] for i in sorted(sorted(range(len(g)), key=lambda i: rank[g[i]])[:2])] for g in grams)
                agree += first == second
            own.append(agree / orderings)
    assert abs(np.mean(shared) - np.mean(own)) < 0.06
    error = np.sqrt(np.mean((np.array(shared) - own).reshape(4, 10) ** 2, axis=1))
    assert (error[:2] < 0.08).all() and (error < 0.12).all(), error


def test_fingerprints(spark):
    a = prose(400, 31)
    w = a.split(" ")
    texts = [a, a, " ".join(w[:200] + w[201:]), " ".join(w[200:] + w[:200]), " ".join(reversed(w)), prose(400, 32), "", None, "one two", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["fingerprint"] for r in order_minhash.order_minhash(docs).collect()}

    def like(i, j):
        return spark.createDataFrame([(out[i], out[j])], "a array<long>, b array<long>").select(order_minhash.likeness(F.col("a"), F.col("b"))).first()[0]

    assert out[0] == out[1] and like(0, 1) == 1
    assert like(0, 2) > 0.85 > like(0, 3) > like(0, 4) and like(0, 5) == 0
    assert out[6] == out[7] == out[9] and like(6, 7) == 1 and like(6, 8) == 0
    assert all(x is None for x in out[6])


def test_order_minhash_query_pairs_documents(spark, small):
    rows = {r["doc_id"]: r for r in order_minhash.op6_order_minhash(spark, small).collect()}
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    import hashlib

    for (k, t), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert rows[k]["n_chars"] == len(t) and rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(rows) == len(docs)
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.1 > np.mean([r["near_next"] for r in rows.values()])


# ---- tool calls ------------------------------------------------------------------------------------------------------

SCHEMAS = {"add": {"x": ("number", True), "note": ("string", False)}}


def test_tool_calls(spark):
    calls = [
        (1, "c", 5, "add", '{"x":1,"note":"b"}', "b"),
        (1, "a", 1, "add", '{"note":"é\\n","x":2.5}', None),
        (1, "b", 3, "add", '{"x":"1","z":0}', "a"),
        (1, "a", 2, "add", '{"x":9}', None),
        (1, "d", 9, "sub", "[1]", "gone"),
        (1, "e", 11, "add", "{", "f"),
        (1, "f", 12, "add", "{}", "e"),
        (1, None, 13, "add", '{"x":1}', None),
        (None, "n", None, None, None, None),
    ]
    results = [(1, "a", 2, "two"), (1, "a", 3, "late"), (1, "b", 3, "early"), (1, None, 4, "none"), (2, "a", 1, "alone"), (None, "n", 3, None)]
    schema = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string"
    out = tool_calls.link_tool_calls(spark.createDataFrame(calls, schema), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMAS).collect()
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in out}
    assert len(out) == len(calls) + 3
    assert [(got[1, k, t]["status"], got[1, k, t]["depth"], got[1, k, t]["seq"]) for k, t in (("a", 1), ("b", 3), ("c", 5))] == [("ok", 0, 0), ("early_result", 1, 2), ("no_result", 2, 3)]
    assert got[1, "a", 2]["status"] == "duplicate_call" and got[1, "a", 3]["status"] == got[1, None, 4]["status"] == got[2, "a", 1]["status"] == "orphan_result"
    assert got[1, "b", 3]["errors"] == ["type:x", "extra:z"]
    assert got[1, "d", 9]["errors"] == ["not_json", "unknown_tool", "unknown_parent"] and got[1, "e", 11]["errors"] == ["not_json", "circle"]
    assert got[1, "f", 12]["errors"] == ["missing:x", "circle"]
    assert got[None, "n", None]["status"] == "no_result" or got[None, "n", None]["status"] == "ok"
    assert got[1, "a", 1]["message"] == '{"arguments":{"note":"é\\n","x":2.5},"call_id":"a","name":"add","result":"two","seq":0,"status":"ok"}'
    assert all(json.loads(r["message"])["seq"] == r["seq"] for r in out)
    none = spark.createDataFrame([], schema)
    assert tool_calls.link_tool_calls(none, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), SCHEMAS).count() == 0


def test_arguments_of_any_name(spark):
    schemas = {"t": {"a.b": ("integer", True), "c d": ("string", True), "it's": ("string", True), "x[0]": ("boolean", False)}}
    calls = [(1, "p", 0, "t", '{"a.b":1,"c d":"x","it\'s":"y","x[0]":true}', None), (1, "q", 1, "t", '{"a":{"b":1},"c d":2,"x[0]":0}', None)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, parent_id string")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r["call_id"]: r["errors"] for r in tool_calls.link_tool_calls(frame, none, schemas).collect()}
    assert got["p"] == [] and got["q"] == ["missing:a.b", "type:c d", "missing:it's", "type:x[0]", "extra:a"]
    with pytest.raises(ValueError, match="quotes"):
        tool_calls.path_of("a'b\"c")


def test_numbers_of_arguments_by_one_rule(spark):
    """Equal values are written alike, whatever their text; what a double cannot hold is an error and stays as it is."""
    schemas = {"t": {"x": ("integer", True), "s": ("string", False)}}
    tokens = ["100", "1e2", "100.0", "1.00E+2", "-0.0", "0", "1.50", "15e-1", "1e22", "123456789012345678901234567890", "1.0000000000000000001", "-2.5e-7", "1e-320", "9007199254740993", "0e5", "1e308"]
    texts = [f'{{"x":{x},"s":"1e2 \\"1.0\\" {x}"}}' for x in tokens]
    lost = ["1e400", "-1e400", "1e-400", "9" * 400, "0." + "0" * 400 + "1"]
    texts += [f'{{"x":{x}}}' for x in lost] + ['{"x":1,"s":"1e400"}', '{"x":[1.0,{"y":1e1}]}', '{"x":1,"s":"' + "\\n1e2\\\"" * 100_000 + '"}']
    frame = spark.createDataFrame([(1, str(i), i, "t", x, None) for i, x in enumerate(texts)], "conv_id long, call_id string, turn long, name string, arguments string, parent_id string")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {int(r["call_id"]): (r["errors"], json.loads(r["message"]), r["message"]) for r in tool_calls.link_tool_calls(frame, none, schemas).collect()}
    for i, x in enumerate(tokens):
        exact = Decimal(x) if len(x) < 38 and "e" not in x.lower() else Decimal(repr(float(x)))
        written = format(exact if exact else Decimal(0), "f")
        written = written.rstrip("0").rstrip(".") if "." in written else written
        assert f'"x":{written}}}' in got[i][2], (x, got[i][2])
        assert got[i][0] == ([] if exact == exact.to_integral_value() else ["type:x"]) and got[i][1]["arguments"]["s"] == f'1e2 "1.0" {x}'
    for i, x in enumerate(lost, len(tokens)):
        assert got[i][0] == ["number_range"] and got[i][1]["raw_arguments"] == f'{{"x":{x}}}' and "arguments" not in got[i][1]
    after = len(tokens) + len(lost)
    assert got[after][0] == [] and got[after + 1][0] == ["type:x"] and '{"x":[1,{"y":10}]}' in got[after + 1][2]
    assert got[after + 2][0] == [] and got[after + 2][1]["arguments"]["s"] == '\n1e2"' * 100_000


def test_long_chains_take_few_rounds(spark):
    calls = [(1, str(i), i, "add", '{"x":1}', str(i - 1) if i else None) for i in range(150)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, parent_id string")
    assert {r["call_id"]: r["depth"] for r in tool_calls.depths(frame).collect()} == {str(i): i for i in range(150)}


def test_tool_call_query_agrees_with_sql(spark, small):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{small}/conversations.parquet'")
    relation = duck.sql(queries.ORACLE_SQL["op1_tool_call_links"])
    names = sorted(relation.columns)
    frame = queries.QUERIES["op1_tool_call_links"](spark, small)
    assert sorted(frame.columns) == names
    at = [relation.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in frame.collect()) == sorted(repr([r[i] for i in at]) for r in relation.fetchall())


def test_native_operators_run_no_python(spark, small):
    for name in ("op1_tool_call_links", "op6_order_minhash", "op10_source_mix"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
