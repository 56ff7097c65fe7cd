import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgelight.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, words long, name string, place string, depth string, member string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.sha256((x or "").encode()).digest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(lambda: {"members": [], "ends": []})
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        said = (own.get(base, [])[:h] + turns[h:])
        for d in range(len(said) + 1):
            nodes[tuple(said[:d])]["members"].append(c)
        nodes[tuple(said)]["ends"].append(c)
    children, out = defaultdict(list), []
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[key]["members"]) - 1) * len(key[-1][1].encode().split()) if key else 0
        below = [sums[k] for k in children[key]]
        sums[key] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    for key, n in nodes.items():
        ends = ",".join(map(str, sorted(n["ends"])))
        parent = min(nodes[key[:-1]]["members"]) if key else None
        out.append((min(n["members"]), len(key), parent, len(n["members"]), len(children[key]), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows):
    turns, lengths = pt.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.prefix_trie(turns, lengths).nodes.collect()), key=repr)


def extra(rows):
    return [(*r, 9, "own", "own", "own", "own") for r in rows]


def test_small_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {'x' * (c % 3 if t > 1 else 0)} end") for c in range(45) for t in range(c % 6)]
    rows += [(60, None, None, None), (60, 0, "user", ""), (61, 2, "user", "b"), (61, 1, "user", "a"), (61, 1, None, "a"), (61, 1, "user", "A"), (None, 0, "user", "x"), (-7, 0, "user", "turn 0  end"), (-30, 5, "", "")]
    rows += [(70, 1, "user", "same")] * 5 + [(71, t, "user", "long " * 20_000) for t in range(3)]
    assert built(spark, extra(rows)) == plain(extra(rows))


@pytest.mark.parametrize("lengths", [(1, 1), (2, 3), (15, 16, 17), (33, 31, 32, 9)])
def test_lengths_around_powers_of_two(spark, lengths):
    rows = [(20 * i + 7, t, "user", "a" if t < 9 else f"{i % 2}") for i, n in enumerate(lengths) for t in range(n)]
    assert built(spark, extra(rows)) == plain(extra(rows))


def test_turnless_and_nothing(spark):
    gone = [(c, 0, "user", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20]  # their bases are absent and they are shorter than h
    assert built(spark, extra(gone)) == plain(extra(gone)) and len(plain(extra(gone))) == 1
    assert built(spark, []) == [] and built(spark, extra([(None, 0, "user", "x")])) == []


def test_members_tell_the_path_of_each_conversation(spark):
    rows = extra([(c, t, "user", f"{(c * 7 + t) % 3}") for c in range(30) for t in range(c % 5)])
    turns, lengths = pt.rebuilt(spark.createDataFrame(rows, SCHEMA))
    trie = pt.prefix_trie(turns, lengths)
    path = trie.members.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("least"))
    assert path.join(trie.nodes, ["conv_id", "depth"]).where("n <> n_convs or least <> conv_id").count() == 0
    assert path.count() == trie.nodes.count()


def test_many_members_of_one_end(spark):
    """More members than a batch holds, over several ranges, still make one digest."""
    ids = spark.range(25_000).select(F.lit(0).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("depth"), F.col("id").alias("member"))
    more = ids.where("member < 3").withColumn("depth", F.lit(2).cast("long"))
    got = {r["depth"]: r["ends_sha256"] for r in pt.end_digests(ids.unionByName(more)).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(25_000))).encode()).hexdigest(), 2: hashlib.sha256(b"0,1,2").hexdigest()}


def test_equal_values_have_equal_names(spark):
    rows = spark.createDataFrame([(i, i % 5, None if i % 7 == 0 else "x") for i in range(100)], "i int, a int, b string").fillna("")
    found = pt.distinct_names(rows, ["a", "b"]).collect()
    names = {(r["a"], r["b"]): r["name"] for r in found}
    assert len(found) == 100 and sorted(names.values()) == list(range(10)) and all(names[r["a"], r["b"]] == r["name"] for r in found)
