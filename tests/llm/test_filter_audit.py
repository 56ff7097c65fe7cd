import itertools
from collections import Counter

import numpy as np
import pytest
from cases import prose
from pyspark.sql import functions as F

from edgelight.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, mask string, part string, good string, step int"
LONG = prose(30_000, 5)
TEXTS = [None, "", " \t\n", "a b a", "A" * 5 + " b" * 300, prose(250, 1), prose(250, 1), prose(199, 2), "hot # " + prose(300, 3), LONG, LONG, "日本 " * 250, "word " * 400]
ROWS = [(i, t, [None, "a", "b"][i % 3], "own", "own", "own", 1) for i, t in enumerate(TEXTS)]
ROWS += [(None, LONG, "a", "", "", "", 1), (None, None, None, "", "", "", 1), (9, LONG, "b", "", "", "", 1), (20, None, "", "", "", "", 1), (5, prose(199, 2), "a", "", "", "", 1)]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, 0), (9, 1, 1), (10, 0, 0), (10, None, None), (None, 1, 1), (77, 1, 1), (8, 1, None), (8, 1, None)]


def plain(rows, labels):
    """The result by looking at each document in each order."""
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    judged = []
    for k, t, s, *_ in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and first[t] < k}
        judged.append((s or "", {f for f, bad in fails.items() if bad}, k in good, k in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {j[0] for j in judged}:
            left = [j for j in judged if j[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in j[1] for j in whole) - len(gone), sum(j[1] == {f} for j in whole), sum(j[2] for j in gone), sum(j[3] for j in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    found = fa.audit(fa.labelled(fa.filter_masks(docs), marks)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in fa.COUNTS) for r in found}
    assert len(got) == len(found)
    return got


def test_against_each_document_in_each_order(spark):
    want = plain(ROWS, LABELS)
    assert len(want) == 3 * 600 and audited(spark, ROWS, LABELS) == want
    assert audited(spark, ROWS, []) == plain(ROWS, [])


def test_nothing_gives_nothing(spark):
    assert audited(spark, [], LABELS) == {}


def test_more_parts_than_a_task_keeps(spark, monkeypatch):
    rows = [(i, f"t{i % 7}", f"s{i % 600}", "", "", "", 1) for i in range(1300)]
    assert audited(spark, rows, [(5, 1, 1)]) == plain(rows, [(5, 1, 1)])


def test_table_of_first_failures():
    table, filters = fa.first_failures("ABCDE")
    assert table.shape == (32, 120) and filters.shape == (120, 5) and (table[0] == 5).all()
    for mask, order in ((0b10010, "EABCD"), (0b00110, "DECBA"), (0b11111, "CABDE")):
        fails = {c for i, c in enumerate("ABCDE") if mask >> i & 1}
        assert table[mask, fa.orders("ABCDE").index(order)] == next(i for i, c in enumerate(order) if c in fails)
    assert fa.first_failures("ABC")[0].shape == (8, 6)


@pytest.mark.parametrize("text", ["", " ", "a", LONG, "a\x0bb\x0cc\x1cd\x00e", "x" * 3_000_000, ("y " * 900_000) + "z" * 2_000_000 + " y"])
def test_words_are_counted_over_slices(text):
    words = text.encode().split()
    assert fa.word_counts(text.encode()) == (len(words), len(set(words)))


def test_the_method_is_the_table(spark, monkeypatch, small):
    """A table that says nothing fails leaves nothing removed."""
    masks = spark.createDataFrame([("p", 5, True, False)] * 4, "part string, mask int, good boolean, toxic boolean")
    batches = [b for b in masks.toArrow().to_batches()]
    monkeypatch.setattr(fa, "first_failures", lambda letters: (np.full((32, 120), 5), np.zeros((120, 5), int)))
    assert not any(sum(b.column("removed").to_pylist()) for b in fa._counted("ABCDE")(iter(batches)))
