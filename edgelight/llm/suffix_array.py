"""Exact removal of repeated byte strings with a suffix array built by bucket-pointer refinement."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_column
from .repeats import Entries, Kind, merged, repeated_windows, runs, window_runs, with_spans

#: Bytes whose suffixes are sorted at once (more only where the fragments of one anchor have more), and suffixes of the buckets
#: that are refined together.
SORTED_BYTES, CHUNK = 1 << 19, 1 << 14


def packed_order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The stable order by several (numbers, bits they need), the first most significant; in one sort of packed numbers where they fit."""
    n = len(keys[0][0])
    places = max(1, n - 1).bit_length()
    if sum(bits for _, bits in keys) + places > 64:
        return np.lexsort([x for x, _ in keys[::-1]])
    packed = np.zeros(n, np.uint64)
    for x, bits in keys:
        packed = (packed << np.uint64(bits)) | x.astype(np.uint64)
    packed = np.sort((packed << np.uint64(places)) | np.arange(n, dtype=np.uint64))
    return (packed & np.uint64((1 << places) - 1)).astype(np.int64)


def initial_buckets(data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each suffix's bucket, in lexicographic order, by its first q bytes, and q: as many as fit into a word beside a place.

    A string's end counts as the smallest byte, so that a suffix shorter than q has a bucket as well.
    """
    code = np.cumsum(np.bincount(data, minlength=256) > 0).astype(np.uint64)
    width = int(code[-1]).bit_length()
    places = max(1, len(data) - 1).bit_length()
    q = max(1, (64 - places) // width)
    padded = np.concatenate([np.where(room > 0, code[data], np.uint64(0)), np.zeros(q, np.uint64)])
    key = np.zeros(len(data), np.uint64)
    for j in range(q):
        key = (key << np.uint64(width)) | padded[j : j + len(data)]
    short = np.flatnonzero(room < q)
    key[short] &= ~((np.uint64(1) << ((q - room[short]) * width).astype(np.uint64)) - np.uint64(1))
    order = packed_order((key, 64 - places))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    bucket = np.empty(len(data), np.int64)
    bucket[order] = np.cumsum(new) - 1
    return bucket, q


def suffix_array(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The suffixes of at least width bytes of the strings that offsets part (each ends in one byte more), sorted by their first width bytes
    at least.

    Bucket-pointer refinement: suffixes fall into buckets by their first q bytes, and pointers lead from suffixes to buckets. The
    buckets are taken in order, small ones together. A bucket of common prefix d is sorted by the pointers of the suffixes d
    later, which parts it into smaller ones of a longer prefix, and so on until each has a single suffix or a prefix of width.
    Pointers are updated at once: where all the suffixes d later are in buckets that are done, their pointers tell them apart
    entirely and one sort ends it; else the initial buckets add q bytes a time. Pointers rise in lexicographic order in either case.
    """
    room = np.repeat(offsets[1:] - 1, np.diff(offsets)) - np.arange(len(data))
    suffixes = np.flatnonzero(room >= width)
    if not len(suffixes):
        return suffixes
    initial, q = initial_buckets(data, room)
    bits = (len(data) + 1).bit_length()
    suffixes = suffixes[packed_order((initial[suffixes], bits))]
    pointer, done = np.zeros(len(data) + width, np.int64), np.zeros(len(data) + width, bool)
    initial = np.concatenate([initial, np.zeros(width, np.int64)])
    heads = np.append(runs(initial[suffixes]), len(suffixes))
    low = 0
    while low < len(suffixes):
        high = int(heads[max(np.searchsorted(heads, low, "right"), np.searchsorted(heads, low + CHUNK, "right") - 1)])
        slots = np.arange(low, high)
        own = heads[(heads >= low) & (heads <= high)]
        bucket = np.repeat(own[:-1], np.diff(own))
        depth = np.full(high - low, q)
        while True:
            # Suffixes that are alone or agree in width bytes have their last pointer.
            head = runs(bucket)
            size = np.diff(np.append(head, len(bucket)))
            members = suffixes[slots]
            pointer[members] = bucket
            ended = np.repeat(size == 1, size) | (depth >= width)
            done[members[ended]] = True
            slots, bucket, depth = slots[~ended], bucket[~ended], depth[~ended]
            if not len(slots):
                break
            head = runs(bucket)
            size = np.diff(np.append(head, len(bucket)))
            members = suffixes[slots]
            later = members + depth
            entire = np.repeat(np.logical_and.reduceat(done[later], head), size)
            key = np.where(entire, pointer[later], initial[later])
            order = packed_order((np.repeat(np.arange(len(head)), size), len(head).bit_length()), (key, bits))
            suffixes[slots] = members[order]
            key, entire = key[order], entire[order]
            new = np.zeros(len(slots), bool)
            new[head] = True
            new[1:] |= key[1:] != key[:-1]
            head = np.flatnonzero(new)
            bucket = np.repeat(slots[head], np.diff(np.append(head, len(slots))))
            depth = np.where(entire, width, depth + q)
        low = high
    return suffixes


def equal_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of width bytes inside the strings that offsets part (each ends in one byte more): starts, equal windows together, and
    where in them each group begins. Neighbours in the suffix array are compared byte by byte, eight at a time."""
    order = suffix_array(data, offsets, width)
    step = min(8, width)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data), "<u8", padded, strides=(1,)) & np.uint64((1 << (8 * step)) - 1)
    same = np.arange(1, len(order))
    for at in sorted({*range(0, width - step, step), width - step}):
        same = same[words[order[same] + at] == words[order[same - 1] + at]]
    new = np.ones(len(order), bool)
    new[same] = False
    return order, np.flatnonzero(new)


def earlier_elsewhere(width: int):
    """A finder: windows that also start in a document with a smaller id.

    Equal windows stand together in the suffix array. The least id of all owners of their entries is the one that keeps them.
    """

    def find(entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(entries.part, kind="stable")
        size = np.diff(entries.bounds)
        total = np.cumsum(size[order] + 1)
        cuts, limit = [0], SORTED_BYTES
        for b in runs(entries.part[order])[1:].tolist():
            if total[b - 1] > limit:
                cuts.append(b)
                limit = total[b - 1] + SORTED_BYTES
        cuts.append(len(order))
        text, begin, end = entries.text.tobytes(), entries.bounds[:-1].tolist(), entries.bounds[1:].tolist()
        found = [(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = order[a:b]
            data = np.frombuffer(b"\n".join([*[text[begin[i] : end[i]] for i in x.tolist()], b""]), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size[x] + 1)])
            starts, first = equal_windows(data, offsets, width)
            if not len(starts):
                continue
            entry = np.repeat(np.arange(len(x)), size[x] + 1)[starts]
            own = entries.least[x][entry]
            smallest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
            repeated = np.flatnonzero(entries.most[x][entry] > smallest)
            found.append(window_runs(x[entry[repeated]], starts[repeated] - offsets[entry[repeated]], (own > smallest)[repeated]))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    return find


def repeated_spans(docs: DataFrame, width: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(uid, id, spans): the windows of width bytes of each document that also start in a document with a smaller id."""
    return repeated_windows(docs, Kind(words=False, width=width, gram=min(16, width), earlier=True), earlier_elsewhere(width), id_column, text_column)


def dedup_bytes(docs: DataFrame, width: int = 50, id_column: str = "doc_id", text_column: str = "text", whole_characters: bool = True) -> DataFrame:
    """docs with kept_text and removed (begin, end byte spans): what is left without strings that smaller ids have as well.

    Each byte goes that is covered by a string of width bytes which also starts in a document with a smaller id; strings
    are judged on the input. whole_characters: a character of which a byte stays, stays (the text remains valid UTF-8).
    A null text stays null, with no spans; an empty or short text is left alone, as is one with a null id. Of rows with one
    id none is smaller, so they do not affect each other. An empty table gives an empty result; all columns stay.
    """
    spans = free_column(docs, "_spans")
    found = repeated_spans(docs, width, id_column, text_column)
    names = [free_column(docs, n) for n in ("kept_text", "removed")]

    @F.pandas_udf("kept_text string, removed array<struct<begin: long, end: long>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, s in zip(texts, spans, strict=True):
            gone = merged(s, width)
            if text is None or not len(gone):
                out.append((text, []))
                continue
            data = text.encode()
            if whole_characters:
                gone = np.array([(a, b) for a, b in (shrink(data, a, b) for a, b in gone.tolist()) if a < b], np.int64).reshape(-1, 2)
            out.append((kept(data, gone).decode(errors="ignore"), [{"begin": a, "end": b} for a, b in gone.tolist()]))
        return pd.DataFrame(out, columns=["kept_text", "removed"])

    joined = with_spans(docs, found, spans, id_column, text_column)
    done = free_column(joined, "_cut")
    joined = joined.withColumn(done, cut(F.col(text_column), F.col(spans)))
    return joined.select(*docs.columns, *[F.col(done)[c].alias(n) for c, n in zip(("kept_text", "removed"), names, strict=True)])


def shrink(data: bytes, begin: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while begin < end and data[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def kept(data: bytes, gone: np.ndarray) -> bytes:
    edge = [0, *gone.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document under the removal that dedup_bytes describes, byte by byte."""
    docs = docs.select("doc_id", "text")
    found = repeated_spans(docs, width)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for data, s in zip(texts, spans, strict=True):
            data, gone = data or b"", merged(s, width)
            removed = int((gone[:, 1] - gone[:, 0]).sum())
            out.append((len(data), removed, len(gone), hashlib.sha256(kept(data, gone)).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_spans(docs, found, "spans", "doc_id", "text")
    return joined.select("doc_id", digest(F.col("text").cast("binary"), "spans").alias("d")).select("doc_id", "d.*")


def op3_suffix_array_dedup(spark, sf_dir):
    return digests(documents(spark, sf_dir))
