"""How text filters interact: what each step of each order of the filters removes, by a table of first failures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, named, scratch, staged

LETTERS = "ABCDE"
#: Limits of filters A to C (words, per cent of words, per cent of code points) and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Parts whose counts a task keeps before it passes them on.
MOST_PARTS = 256
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS, _CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


@cache
def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


@cache
def first_failures(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """(table, filters): the step (from 0; len(letters) for none) at which a mask of failed filters first fails in an order, and the filter of each step.

    Bit i of a mask stands for letters[i]; five letters give a table of 32 masks by 120 orders.
    """
    filters = np.array([[letters.index(x) for x in order] for order in orders(letters)])
    fails = (np.arange(1 << len(letters))[:, None, None] >> filters[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), len(letters)), filters


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words, taken slice by slice, so that of a long text only the distinct words are held."""
    total, seen, at = 0, set(), 0
    while at < len(data):
        space = _SPACE.search(data, at + SLICE) if at + SLICE < len(data) else None
        end = space.start() if space else len(data)
        words = data[at:end].split()  # at space and the control characters 9 to 13, as for bytes everywhere
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_mask(data: bytes) -> int:
    """Which of the filters A to D a text fails."""
    words, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUATION))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, len(data.translate(None, SYMBOLS)) < len(data))
    return sum(bool(f) << i for i, f in enumerate(fails))


def _judged(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        masks = [text_mask(t or b"") for t in texts]
        digests = [hashlib.sha256(t or b"").digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def filter_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): a row for each document with the filters that it fails; the table is staged.

    A: under 200 words. B: distinct words under 50 % of the words. C: capitals A-Z over 2 % of the code points. D: holds one of #$%&*|.
    E: its text is that of a smaller doc_id anywhere in the table. part is the source, the empty string for none; a null text is the empty one.
    A null doc_id is smaller than none and larger than none, so its rows pass E; rows that share an id do not fail each other.
    Texts meet by their SHA-256, in rows of a few dozen bytes; groups of copies are counted map-side first.
    """
    narrow = named(docs, "doc_id", "text", "source").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = staged(narrow.mapInArrow(_judged, f"doc_id {kind}, part string, mask int, digest binary"))
    ids = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = staged(ids.where("first < last").select("digest", "first"))  # staged, so that the join below can split a text with very many copies
    copies = judged.join(firsts, "digest", "left")
    return copies.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def _counted(letters: str):
    def count(batches: Iterator) -> Iterator:
        """Adds up removals by part, order and step, and passes the sums on in rows of the result."""
        import pyarrow as pa

        table, filters = first_failures(letters)
        n, steps = len(filters), len(letters)
        bits = (np.arange(1 << steps)[:, None] >> np.arange(steps)) & 1
        kept: dict[str, tuple] = {}

        def flushed():
            for part, (gone, good, toxic, masks) in kept.items():
                removed = gone[:, :steps]
                shapley = np.bincount(filters.ravel(), weights=removed.ravel(), minlength=steps).astype(np.int64)
                columns = [len(masks) and masks.sum() - removed.cumsum(1), removed, (masks @ bits)[filters] - removed, masks[1 << filters], good[:, :steps], toxic[:, :steps], shapley[filters]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (n * steps), pa.string()), pa.array(np.repeat(orders(letters), steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n)), *[pa.array(np.ascontiguousarray(c, np.int64).ravel()) for c in columns]],
                    names=["part", "filter_order", "step", *COUNTS],
                )
            kept.clear()

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            codes, mask = parts.indices.to_numpy().astype(np.int64), batch.column("mask").to_numpy()
            size = len(parts.dictionary) * n * (steps + 1)
            at = (codes[:, None] * n + np.arange(n)) * (steps + 1) + table[mask]
            marks = [np.ones(len(mask), bool), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]]
            sums = [np.bincount(at[m].ravel(), minlength=size).reshape(-1, n, steps + 1) for m in marks]
            masks = np.bincount(codes * len(bits) + mask, minlength=len(parts.dictionary) * len(bits)).reshape(-1, len(bits))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                new = (*[s[i] for s in sums], masks[i])
                kept[part] = tuple(a + b for a, b in zip(kept[part], new, strict=True)) if part in kept else new
            if len(kept) >= MOST_PARTS:
                yield from flushed()
        yield from flushed()

    return count


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, and COUNTS): for each part, order of the filters and step, what is kept and removed.

    masks: part, mask (bit i for letters[i]), good and toxic (boolean). Each task looks up the first failures of its documents and adds them up;
    the partial sums of all tasks meet in one aggregate, so that a part with very many documents is no hot spot. redundant: fails the step's
    filter, removed earlier; unique_fails: fails no other filter; shapley: what the filter removes, over all orders. Parts without documents
    have no rows; an empty table gives none.
    """
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    partial = masks.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic").mapInArrow(_counted(letters), f"part string, filter_order string, step int, {kinds}")
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks with good and toxic: whether any label of the id says quality 1, toxic 1. A null id or one without labels is neither."""
    marks = named(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = staged(marks.where("doc_id is not null and (good or toxic)"))
    marked = masks.join(marks, "doc_id", "left")
    return marked.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def op11_filter_audit(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with scratch() as keep:
        return keep(staged(audit(labelled(filter_masks(documents(spark, sf_dir)), labels))))
