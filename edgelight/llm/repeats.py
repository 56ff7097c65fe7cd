"""What suffix-array and suffix-tree deduplication share: finding the few places where a repeat can be, and moving them.

A repeat is a window of `width` units (bytes or words) that occurs twice. Each window has an anchor: among its runs of
`gram` units the one with the smallest hash, the leftmost if several. Equal windows have equal anchors, and neighbouring
windows mostly share theirs, so about one unit in (width - gram) / 2 is an anchor. Two steps follow.

1. `shared_anchors`: which anchors occur in two documents, or twice in one. Anchors go to buckets by hash, packed, each
   anchor once per slice of a batch; a slice knows of repeats inside itself at once. Hashes only choose: what they claim
   is repeated is a candidate, and what they miss cannot be repeated.
2. `fragments`: the stretch of text that the windows of a shared anchor cover goes to the anchor's bucket, equal stretches
   of a slice once (compared byte by byte). An anchor in HOT_LEAST documents or more is hot: there each window travels by
   itself, to a bucket by a hash of the whole window, so that a passage in a third of all documents is spread and merged
   map-side. At most the HOT_MOST most frequent anchors are hot, so that their table has a fixed size; any choice of hot
   anchors gives the same result. Which anchors of a document are shared reaches it by a join on its key.

Fragments of equal bytes are one entry with several owners, in a slice and in a bucket; that is storage and decides nothing. A
finder (suffix array or suffix tree) goes over the entries and says which windows are repeated for which of their owners: in a
slice over the entries that have several, in a bucket over all. Of what a slice has decided only the spans travel on.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import discard, free_column, staged
from .hashing import BLOCK, U64, mix64

_UP = hashing._powers(hashing._BASE, BLOCK + (1 << 12))
_DOWN = hashing._powers(pow(hashing._BASE, -1, 1 << 64), BLOCK + (1 << 12))
_POSITION = U64((1 << 19) - 1)
#: Text that one bucket stands for, and that a task looks at at once.
BUCKET_BYTES, SLICE_BYTES = 16 << 20, 4 << 20
#: Documents that make an anchor hot, and how many anchors may be (five bytes each in every task).
HOT_LEAST, HOT_MOST = 1 << 14, 1 << 18


@dataclass(frozen=True)
class Kind:
    """words: units are words, else bytes. earlier: a window counts as repeated only if it also starts in a document with a smaller id."""

    words: bool
    width: int
    gram: int
    earlier: bool


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    with np.errstate(over="ignore"):
        for b in range(0, n, BLOCK):
            part = units[b : b + BLOCK + k - 1]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(part * _UP[: len(part)], dtype=U64, out=sums[1:])
            out[b : b + BLOCK] = (sums[k:] - sums[:-k]) * _DOWN[: len(part) - k + 1]
        return mix64(out)


def stretch_hashes(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of any length; units has BLOCK + width units at most."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(units) + 1, U64)
        np.cumsum(units * _UP[: len(units)], dtype=U64, out=sums[1:])
        return mix64((sums[starts + lengths] - sums[starts]) * _DOWN[starts] ^ mix64(lengths.astype(U64)))


@dataclass
class Piece:
    """Units of some documents, end to end; a long document comes in pieces that overlap by width - 1 units."""

    units: np.ndarray
    bounds: np.ndarray  # of the documents, in units
    rows: np.ndarray  # of the documents, in the batch
    base: int  # the first unit's number in its document, if that is in pieces
    begin: np.ndarray | None  # of words: where they start and end in the batch's bytes
    end: np.ndarray | None
    origin: int  # of bytes: where the first is in the batch's bytes


def pieces(data: np.ndarray, offsets: np.ndarray, kind: Kind) -> Iterator[Piece]:
    lengths, row, n = np.diff(offsets), 0, len(offsets) - 1
    while row < n:
        last = row + 1
        while last < n and offsets[last + 1] - offsets[row] <= BLOCK:
            last += 1
        rows = np.arange(row, last)
        low, high = int(offsets[row]), int(offsets[last])
        part = data[low:high]
        if kind.words:
            space = hashing._SPACE[part]
            first = np.zeros(len(part) + 1, bool)
            first[offsets[row : last + 1] - low] = True
            inside = ~space
            before = np.concatenate([[True], space[:-1]]) if len(part) else space
            after = np.concatenate([space[1:], [True]]) if len(part) else space
            begin = np.flatnonzero(inside & (before | first[:-1]))
            end = np.flatnonzero(inside & (after | first[1:])) + 1
            units = hashing.range_hashes(part, begin, end, fold=False)
            bounds = np.searchsorted(begin, offsets[row : last + 1] - low)
            begin, end = begin + low, end + low
        else:
            units, bounds, begin, end = hashing._BYTE[part], offsets[row : last + 1].astype(np.int64) - low, None, None
        if len(units) <= BLOCK:
            yield Piece(units, bounds, rows, 0, begin, end, low)
        else:  # one document alone
            for b in range(0, len(units) - kind.width + 1, BLOCK):
                u = units[b : b + BLOCK + kind.width - 1]
                span = slice(b, b + len(u))
                yield Piece(u, np.array([0, len(u)]), rows, b, begin if begin is None else begin[span], end if end is None else end[span], low + b)
        row = last
    del lengths


def anchors(piece: Piece, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each whole window: its start, its document's place in the piece, its anchor's place and its anchor's hash (40 bits)."""
    n = len(piece.units) - kind.width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    g = grams(piece.units, kind.gram)
    least, span, window = (g & ~_POSITION) | np.arange(len(g), dtype=U64), 1, kind.width - kind.gram + 1
    while span * 2 <= window:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < window:
        least = np.minimum(least[: span - window], least[window - span :])
    document = np.repeat(np.arange(len(piece.rows)), np.diff(piece.bounds))[:n]
    start = np.flatnonzero(piece.bounds[1:][document] - np.arange(n) >= kind.width)
    at = (least[start] & _POSITION).astype(np.int64)
    return start, document[start], at, g[at] >> U64(24)


def bytes40(h: np.ndarray) -> np.ndarray:
    """Five bytes per hash, one hash after the other."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def pack40(h: np.ndarray) -> bytes:
    return bytes40(h).tobytes()


def unpack40(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U64)


def binary_column(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The byte strings between neighbouring edges of data."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in runs of SLICE_BYTES of their second column (a longer text alone), so that memory does not follow the batch size."""
    for batch in batches:
        _, _, offsets = text_columns(batch)
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(row, last - row)
            row = last


def text_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, all bytes and where each text starts in them, without copies."""
    texts = batch.column(1)
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(data or b"", np.uint8), offsets


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def anchor_rows(kind: Kind, buckets: int) -> Callable:
    """mapInArrow over (id, bytes): (key, tag, id, blob). Tag 0: anchors of a batch for bucket key, each once, with the number of
    documents that have it. Tag 1: anchors of one document that the batch has seen twice; the document chooses the bucket, which
    only passes them on, as the anchors of many copies of one text would all choose the same."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, data, offsets = text_columns(batch)
            rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
            for piece in pieces(data, offsets, kind):
                _, document, at, h = anchors(piece, kind)
                first = runs(at)
                rows.append(piece.rows[document[first]])
                hashes.append(h[first])
            row, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            # One entry per anchor and document; with words, an anchor twice in one document is a repeat as well.
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            row, h = row[first], h[first]
            head = runs(h)
            n = np.diff(np.append(head, len(h)))
            total = np.add.reduceat(times, head) if len(head) else n
            twice = np.repeat((n > 1) if kind.earlier else (total > 1), n)
            out: list[tuple] = []
            known = np.flatnonzero(twice)
            known = known[np.argsort(row[known], kind="stable")]
            edge = np.append(runs(row[known]), len(known))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                r = row[known[a]]
                out.append((int(ids[r]) % buckets, 1, int(ids[r]), pack40(h[known[a:b]])))
            row, h = row[head], h[head]
            key = (h % U64(buckets)).astype(np.int64)
            order = np.lexsort((row, key))
            row, h, key, n = row[order], h[order], key[order], np.minimum(n[order], 65535)
            edge = np.append(runs(key), len(key))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                documents = runs(row[a:b])
                each = np.diff(np.append(documents, b - a))
                blob = struct.pack("<II", len(documents), b - a) + ids[row[a:b][documents]].astype("<i8").tobytes() + each.astype("<u4").tobytes() + n[a:b].astype("<u2").tobytes() + pack40(h[a:b])
                out.append((int(key[a]), 0, 0, blob))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["key", "tag", "id", "blob"])

    return emit


def find_shared(table: pa.Table) -> pa.Table:
    """Of one bucket: (tag, id, anchor, blob): tag 1, an anchor of id that is shared, or several packed; tag 2, a hot anchor and, as id, in how
    many documents it is. A row for each shared anchor, not for each document and bucket, as there are as many whatever the buckets."""
    tags = table.column("tag").to_numpy()
    passed = table.select(["tag", "id", "blob"]).filter(pa.array(tags == 1))
    passed = passed.add_column(2, "anchor", pa.nulls(passed.num_rows, pa.int64()))
    ids, counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for blob in table.column("blob").filter(pa.array(tags == 0)):
        blob = memoryview(blob.as_buffer())
        documents, n = struct.unpack_from("<II", blob)
        at = 8 + 8 * documents
        each = np.frombuffer(blob, "<u4", documents, at)
        ids.append(np.repeat(np.frombuffer(blob, "<i8", documents, 8), each))
        counts.append(np.frombuffer(blob, "<u2", n, at + 4 * documents).astype(np.int64))
        hashes.append(unpack40(blob[at + 4 * documents + 2 * n :]))
    i, c, h = np.concatenate(ids), np.concatenate(counts), np.concatenate(hashes)
    del ids, counts, hashes
    order = np.argsort(h, kind="stable")
    i, c, h = i[order], c[order], h[order]
    head = runs(h)
    batches = np.diff(np.append(head, len(h)))
    documents = np.add.reduceat(c, head) if len(head) else batches
    x = np.flatnonzero(np.repeat(batches > 1, batches))
    x = x[np.argsort(i[x], kind="stable")]
    hot = np.flatnonzero(documents >= HOT_LEAST)
    out, hot = (pa.table({"tag": pa.array(np.full(len(n), tag), pa.int32()), "id": pa.array(n), "anchor": pa.array(at.view(np.int64)), "blob": pa.nulls(len(n), pa.binary())}) for tag, n, at in ((1, i[x], h[x]), (2, documents[hot], h[head[hot]])))
    return pa.concat_tables([passed, out, hot])


def fragment_rows(kind: Kind, buckets: int, hot: np.ndarray, finder: Finder) -> Callable:
    """mapInArrow over (uid, bytes, shared anchors array<long>, more of them packed array<binary>, id): (key, uid, id, spans, blob). With blob: fragments for bucket key. Without:
    windows of one document (starts and lengths of runs) that the finder says are repeated within the slice; the document chooses the bucket, which only
    passes them on."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, data, offsets = text_columns(batch)
            single = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            known, own = np.unique(np.concatenate([single, unpack_lists(batch.column(3).flatten())])), batch.column(4).to_numpy(zero_copy_only=False)
            parts = []
            for piece in pieces(data, offsets, kind):
                start, document, at, h = anchors(piece, kind)
                # Runs of windows with one anchor; only their heads are looked up.
                new = np.ones(len(start), bool)
                new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                windows = np.diff(np.append(first, len(start)))
                keep = found_in(h[first], known)
                first, windows = first[keep], windows[keep]
                if not len(first):
                    continue
                alone = found_in(h[first], hot)
                if alone.any():  # each window of a hot anchor by itself
                    times = np.where(alone, windows, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    first, windows, alone = np.repeat(first, times) + step, np.repeat(np.where(alone, 1, windows), times), np.repeat(alone, times)
                s, d = start[first], document[first]
                content = stretch_hashes(piece.units, s, windows + kind.width - 1)
                key = np.where(alone, content, mix64(h[first]))
                if kind.words:
                    low, high = piece.begin[s], piece.end[s + windows + kind.width - 2]
                else:
                    low, high = s + piece.origin, s + piece.origin + windows + kind.width - 1
                parts.append((piece.rows[d], s - piece.bounds[d] + piece.base, windows, content, key, low, high))
            if parts:
                yield from packed_fragments(kind, buckets, finder, ids, own, data, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return emit


def packed_fragments(kind: Kind, buckets: int, finder: Finder, ids, own, data, row, first, windows, content, key, low, high) -> Iterator[pa.RecordBatch]:
    """The rows of fragment_rows for one slice: row by row of it, where fragments begin (units), their windows, hashes, and bytes [low, high)."""
    order = np.lexsort((first, own[row], content))
    row, first, windows, content, key, low, high = (x[order] for x in (row, first, windows, content, key, low, high))
    text = memoryview(data)
    head = runs(content)
    n = np.diff(np.append(head, len(content)))
    # What the hash calls equal is compared with the first of its run.
    at = np.repeat(head, n)
    same = np.repeat(n > 1, n)
    pairs = np.flatnonzero(same)
    edges = (x.tolist() for x in (low[at[pairs]], high[at[pairs]], low[pairs], high[pairs]))
    same[pairs] = [text[a:b] == text[c:d] for a, b, c, d in zip(*edges, strict=True)]
    later = same & (np.arange(len(at)) != at)
    del edges
    # Ids rise within equal content. With smaller ids asked for, fragments of the smallest id all go on, else the first of each content does.
    sent = ~(later & (own[row] != own[row[at]])) if kind.earlier else ~later
    some = np.unique(at[later])
    same[np.setdiff1d(head, some, assume_unique=True)] = False
    x = np.flatnonzero(same)
    if len(x):
        entry = np.searchsorted(some, at[x])
        content = np.frombuffer(b"".join([text[a:b] for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True)]), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(high[some] - low[some])])
        if kind.words:
            content, bounds, _, _ = numbered_words(content, bounds)
        entries = Entries((key[some] >> U64(56)).astype(np.uint8), windows[some], *owners_of(own[row[x]], entry, len(some)), content, bounds)
        f, place, count = owned_runs(entries, entry, own[row[x]], finder)
        uid, own_ids, edge, spans = merged_runs(ids[row[x[f]]], own[row[x[f]]], first[x[f]] + place, count)
        yield fragment_batch(uid % buckets, uid, own_ids, binary_column(spans.astype("<i8").view(np.uint8).ravel(), 16 * edge), None)
    x = np.flatnonzero(sent)
    bucket = (key[x] % U64(buckets)).astype(np.int64)
    order = np.lexsort((row[x], bucket))
    x, bucket = x[order], bucket[order]
    edge = np.append(runs(bucket), len(bucket))
    for some in range(0, len(edge) - 1, 256):
        of = list(zip(edge[some : min(some + 256, len(edge) - 1)], edge[some + 1 : some + 257], strict=True))
        blobs = pa.array([pack_fragments(kind, x[a:b], ids, own, row, first, windows, key, low, high, text) for a, b in of], pa.binary())
        zero = np.zeros(len(of), np.int64)
        yield fragment_batch(np.array([bucket[a] for a, _ in of]), zero, zero, None, blobs)


def fragment_batch(key: np.ndarray, uid: np.ndarray, ids: np.ndarray, spans: pa.Array | None, blobs: pa.Array | None) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), none if spans is None else spans, none if blobs is None else blobs], names=["key", "uid", "id", "spans", "blob"])


def merged_runs(uid: np.ndarray, ids: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per document (uid and id) its runs of windows, those that touch as one: uid, id, where each document's runs begin (one more), and the
    runs as (start, windows)."""
    order = np.lexsort((first, ids, uid))
    uid, ids, first, end = uid[order], ids[order], first[order], (first + windows)[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (ids[1:] != ids[:-1])
    # A window is in one run of a document only, but rows that repeat an id and a text may bring each run twice.
    gap = new.copy()
    gap[1:] |= first[1:] > end[:-1]
    head = np.flatnonzero(gap)
    last = np.maximum.reduceat(end, head) if len(head) else end
    spans = np.column_stack([first[head], last - first[head]])
    mine = np.flatnonzero(new[head])
    return uid[head][mine], ids[head][mine], np.append(mine, len(head)), spans


def found_in(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which values are among members, which rise."""
    if not len(members):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(members, values), len(members) - 1)
    return members[at] == values


def pack_fragments(kind: Kind, x: np.ndarray, ids, own, row, first, windows, key, low, high, text: memoryview) -> bytes:
    """Fragments x, sorted by row: their documents once each, then where each begins, its key's part, windows and bytes; compressed."""
    head = runs(row[x])
    documents = row[x[head]]
    each = np.diff(np.append(head, len(x)))
    sizes = (high[x] - low[x]).astype("<u4").tobytes() if kind.words else b""
    parts = [struct.pack("<II", len(head), len(x)), ids[documents].astype("<i8").tobytes(), own[documents].astype("<i8").tobytes(), each.astype("<u4").tobytes()]
    parts += [first[x].astype("<u4").tobytes(), (key[x] >> U64(56)).astype("u1").tobytes(), windows[x].astype("<u2").tobytes(), sizes]
    raw = b"".join([*parts, *[text[a:b] for a, b in zip(low[x].tolist(), high[x].tolist(), strict=True)]])
    return struct.pack("<I", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack_fragments(kind: Kind, blob: memoryview) -> tuple[np.ndarray, ...]:
    """uid, id, first, part, windows and size of each fragment, and the bytes of all."""
    (length,) = struct.unpack_from("<I", blob)
    blob = pa.Codec("zstd").decompress(blob[4:], length, asbytes=True)
    documents, n = struct.unpack_from("<II", blob)
    at = 8
    columns = []
    for type_, count in (("<i8", documents), ("<i8", documents), ("<u4", documents), ("<u4", n), ("<u1", n), ("<u2", n), *[("<u4", n)] * kind.words):
        columns.append(np.frombuffer(blob, type_, count, at))
        at += int(type_[2]) * count
    uid, own, each, first, part, windows = columns[:6]
    size = columns[6].astype(np.int32) if kind.words else windows.astype(np.int32) + (kind.width - 1)
    return np.repeat(uid, each), np.repeat(own, each), first.astype(np.int64), part, windows.astype(np.int32), size, np.frombuffer(blob, np.uint8, -1, at)


def unpack_lists(blobs: pa.Array) -> np.ndarray:
    return unpack40(b"".join(blobs.to_pylist()))


@dataclass
class Entries:
    """The fragments of a bucket, those of equal content as one entry."""

    part: np.ndarray  # of its key: equal windows are in one part
    windows: np.ndarray
    least: np.ndarray  # the smallest id of its owners
    most: np.ndarray  # the largest
    owners: np.ndarray  # how many there are
    text: np.ndarray  # bytes, or numbers of words
    bounds: np.ndarray  # where each begins in text, one more than entries


#: Says which windows are repeated, as runs: (entry, place, windows, whether for all owners or only for those with more than the least id).
Finder = Callable[[Entries], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def owners_of(ids: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least and the largest id of the owners of each of n entries, and how many there are."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, entry, ids)
    np.maximum.at(most, entry, ids)
    return least, most, np.bincount(entry, minlength=n)


def window_runs(entry: np.ndarray, place: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, each once, as the runs that a finder returns: neighbours in an entry that are repeated for the same owners are one."""
    order = np.lexsort((place, entry))
    entry, place, every = entry[order], place[order], every[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (place[1:] != place[:-1] + 1) | (every[1:] != every[:-1])
    head = np.flatnonzero(new)
    return entry[head], place[head], np.diff(np.append(head, len(entry))), every[head]


def owned_runs(entries: Entries, entry: np.ndarray, ids: np.ndarray, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the finder says of the entries, for fragments of which it gives each one's entry and id: (fragment, place, windows)."""
    at, place, count, every = finder(entries)
    beyond = ids > entries.least[entry]
    out = []
    for f, use in ((np.flatnonzero(beyond), np.arange(len(at))), (np.flatnonzero(~beyond), np.flatnonzero(every))):
        use = use[np.argsort(at[use], kind="stable")]
        times = np.bincount(at[use], minlength=len(entries.part))
        begin, each = np.cumsum(times) - times, times[entry[f]]
        run = use[np.repeat(begin[entry[f]] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        out.append((np.repeat(f, each), place[run], count[run]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def numbered_words(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings that bounds part, none of which begins or ends in white space: their words as numbers (equal for equal words, from a
    dictionary of the words themselves), where each string's words begin, the bytes with one space after each word, and where words begin there."""
    space = hashing._SPACE[text]
    first = np.zeros(len(text) + 1, bool)
    first[bounds] = True
    before = np.ones(len(text), bool)
    before[1:] = space[:-1]
    begin = np.flatnonzero(~space & (before | first[:-1]))
    after = np.ones(len(text), bool)
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | first[1:])) + 1
    # Each word moves left by the white space before it that goes; a space is put after it.
    edges = np.concatenate([[0], np.cumsum(end - begin + 1)])
    plain = np.full(edges[-1], 32, np.uint8)
    stays = np.ones(edges[-1], bool)
    stays[edges[1:] - 1] = False
    plain[stays] = text[~space]
    codes = binary_column(plain, edges).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes, np.searchsorted(begin, bounds), plain, edges


def collapse(kind: Kind, ids: np.ndarray, part: np.ndarray, windows: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[Entries, np.ndarray]:
    """The entries of some fragments, and the entry of each fragment. A dictionary of whole contents tells which are equal."""
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    words = None
    if kind.words:
        codes, words, text, edges = numbered_words(text, bounds)
        bounds = edges[words]
    entry = binary_column(text, bounds).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n = int(entry.max()) + 1 if len(entry) else 0
    some = np.zeros(n, np.int64)
    some[entry[::-1]] = np.arange(len(entry))[::-1]  # the first fragment of each entry
    source, bounds = (codes, words) if kind.words else (text, bounds)
    lengths = np.diff(bounds)[some]
    # First fragments rise, so that their units can be picked by a mask.
    picked = np.zeros(len(bounds) - 1, bool)
    picked[some] = True
    return Entries(part[some], windows[some], *owners_of(ids, entry, n), source[np.repeat(picked, np.diff(bounds))], np.concatenate([[0], np.cumsum(lengths)])), entry


#: A run of windows as one number: where it starts, and in the low bits how many there are; longer ones come in parts.
RUN_BITS = 20


def run_rows(uid: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> pa.Table:
    """(uid, id, run), a row for each of the runs (start, windows): as many as there are repeats, whatever the number of buckets."""
    most = (1 << RUN_BITS) - 1
    parts = -(-spans[:, 1] // most)
    step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    start, windows = np.repeat(spans[:, 0], parts) + step, np.minimum(np.repeat(spans[:, 1], parts) - step, most)
    return pa.table({"uid": pa.array(np.repeat(uid, parts)), "id": pa.array(np.repeat(ids, parts)), "run": pa.array((start << RUN_BITS) | windows)})


def resolve_bucket(kind: Kind, finder: Finder) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: (uid, id, run) with the windows that the finder says are repeated, and those that slices have passed on."""

    def resolve(table: pa.Table) -> pa.Table:
        decided = table.column("blob").is_null()
        known = table.filter(decided).combine_chunks()
        spans = np.frombuffer(b"".join(known.column("spans").to_pylist()), "<i8").reshape(-1, 2)
        times = np.array([len(x) // 16 for x in known.column("spans").to_pylist()], np.int64)
        passed = run_rows(np.repeat(known.column("uid").to_numpy(), times), np.repeat(known.column("id").to_numpy(), times), spans)
        heads = [unpack_fragments(kind, memoryview(blob.as_buffer())) for blob in table.column("blob").drop_null()]
        if not heads:
            return passed
        uid, ids, first, part, windows, size, text = (np.concatenate(x) for x in zip(*heads, strict=True))
        del heads
        entries, entry = collapse(kind, ids, part, windows, size, text)
        del text, size, part
        f, place, count = owned_runs(entries, entry, ids, finder)
        uid, ids, edge, spans = merged_runs(uid[f], ids[f], first[f] + place, count)
        times = np.diff(edge)
        return pa.concat_tables([passed, run_rows(np.repeat(uid, times), np.repeat(ids, times), spans)])

    return resolve


def row_key(id_column: str, text_column: str) -> Column:
    """Rows of one id with different texts have different keys."""
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column))


def repeated_windows(docs: DataFrame, kind: Kind, finder: Finder, id_column: str, text_column: str) -> DataFrame:
    """(uid, id, spans array<long>): for each row (row_key and id) with repeated windows, runs of their starts, in units."""
    spark = docs.sparkSession
    narrow = docs.select(row_key(id_column, text_column).alias("uid"), F.col(text_column).cast("binary").alias("text"), F.col(id_column).cast("long").alias("id")).where("id is not null and text is not null")
    size = narrow.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    # Texts too short for a window have none; of words this tells only what is certain.
    narrow = narrow.where(F.length("text") >= (2 * kind.width - 1 if kind.words else kind.width))
    marked = narrow.select("uid", "text").mapInArrow(anchor_rows(kind, buckets), "key int, tag int, id long, blob binary")
    shared = staged(marked.groupBy("key").applyInArrow(find_shared, "tag int, id long, anchor long, blob binary"))
    hottest = shared.where("tag = 2").orderBy(F.col("id").desc(), "anchor").limit(HOT_MOST).select("anchor").collect()
    hot = np.unique(np.array([r["anchor"] for r in hottest], U64))
    lists = shared.where("tag = 1").groupBy(F.col("id").alias("of")).agg(F.collect_list("anchor").alias("shared"), F.collect_list("blob").alias("packed"))
    marked_docs = narrow.join(lists, F.col("uid") == F.col("of")).select("uid", "text", "shared", "packed", "id")
    moved = marked_docs.mapInArrow(fragment_rows(kind, buckets, hot, finder), "key int, uid long, id long, spans binary, blob binary")
    spans = staged(moved.groupBy("key").applyInArrow(resolve_bucket(kind, finder), "uid long, id long, run long"))
    discard(shared)
    return spans.groupBy("uid", "id").agg(F.collect_list("run").alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame, spans: str, id_column: str, text_column: str) -> DataFrame:
    """docs with the spans that repeated_windows has found of each row, or null."""
    uid, of, rid = (free_column(docs, c) for c in ("_uid", "_of", "_id"))
    found = found.select(F.col("uid").alias(of), F.col("id").alias(rid), F.col("spans").alias(spans))
    keyed = docs.withColumn(uid, row_key(id_column, text_column))
    return keyed.join(found, (F.col(uid) == F.col(of)) & (F.col(id_column).cast("long") == F.col(rid)), "left").drop(uid, of, rid)


def merged(spans: np.ndarray | None, width: int) -> np.ndarray:
    """The units that runs of windows cover, as rising separate (begin, end); adjoining ones are one."""
    if spans is None or not len(spans):
        return np.zeros((0, 2), np.int64)
    x = np.sort(np.asarray(spans, np.int64))
    begin = x >> RUN_BITS
    end = np.maximum.accumulate(begin + (x & ((1 << RUN_BITS) - 1)) + width - 1)
    head = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.column_stack([begin[head], end[np.append(head[1:] - 1, len(x) - 1)]])
