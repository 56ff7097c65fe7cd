"""Packing token streams into fixed windows, in order, with cuts chosen by dynamic programming."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, free_column

#: Tokens of padding that a cut inside a document is worth: after a sentence, and anywhere else.
SENTENCE_CUT, HARD_CUT = 8, 32
#: Where a sentence is longer than this, it may be cut after as many tokens.
HARD_STEP = 32
#: Tokens that are planned at once, and the last windows of a plan that the next one may change.
PLAN_TOKENS, REPLANNED = 1 << 18, 4


class Tokens:
    """Ids of a byte-level BPE vocabulary, and which of them end a sentence."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = self._ranked(vocabulary)
        ends = np.zeros(self.slow.get_vocab_size(), bool)
        for token, i in self.slow.get_vocab().items():
            ends[i] = token.rstrip("Ġ")[-1:] in (".", "!", "?", "Ċ", "。")
        self.ends = ends
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    @staticmethod
    def _ranked(vocabulary: str):
        """The same vocabulary in tiktoken, several times as fast in one thread; None where its ranks are not beside it."""
        import os

        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def cut_points(lengths: np.ndarray, ends: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream of documents may be cut, and at what cost; ends marks the tokens that end a sentence."""
    total, step = int(lengths.sum()), min(HARD_STEP, capacity)
    cost = np.zeros(total + 1, np.int32)
    inside = np.flatnonzero(ends[:-1]) + 1 if total else np.zeros(0, np.int64)
    cost[inside] = SENTENCE_CUT
    bounds = np.cumsum(lengths)
    free = np.zeros(total + 1, bool)
    free[inside] = free[0] = True
    free[bounds] = True
    cost[bounds] = 0
    points = np.flatnonzero(free)
    gaps = np.diff(points)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        hard = np.concatenate([np.arange(points[i] + step, points[i + 1], step) for i in wide])
        cost[hard] = HARD_CUT
        free[hard] = True
        points = np.flatnonzero(free)
    return points, cost[points]


def cut(points: np.ndarray, cost: np.ndarray, capacity: int) -> list[int]:
    """The cheapest cuts from points[0] to points[-1], windows of at most capacity: padding plus the cost of each cut.

    best(j) = capacity + cost(j) - points[j] + min over i of (best(i) + points[i]) with points[j] - points[i] <= capacity.
    The minimum runs over a sliding range, so a queue that keeps only rising values has it in front: each point enters and
    leaves once. Neighbouring points must not be further apart than capacity.
    """
    at, price = points.tolist(), cost.tolist()
    queue = deque([(at[0], 0 + at[0], 0)])
    back = [0] * len(at)
    for j in range(1, len(at)):
        p = at[j]
        while queue[0][0] < p - capacity:
            queue.popleft()
        _, least, i = queue[0]
        back[j] = i
        value = least + capacity + price[j]  # best(j) + points[j]
        while queue and queue[-1][1] >= value:
            queue.pop()
        queue.append((p, value, j))
    chosen, j = [], len(at) - 1
    while j:
        chosen.append(at[j])
        j = back[j]
    return chosen[::-1]


class Packer:
    """Packs the documents of one partition, as they come, with a bounded number of tokens in hand."""

    def __init__(self, tokens: Tokens, capacity: int, end_id: int, first: int):
        self.tokens, self.capacity, self.end_id, self.sequence = tokens, capacity, end_id, first
        self.keys, self.ids, self.starts, self.totals, self.held = [], [], [], [], 0

    def add(self, key: int, text: str | None) -> Iterator[tuple]:
        ids = np.append(self.tokens.ids(text) if text else np.zeros(0, np.uint32), np.uint32(self.end_id))
        self.keys.append(key)
        self.ids.append(ids)
        self.starts.append(0)
        self.totals.append(len(ids))
        self.held += len(ids)
        if self.held >= PLAN_TOKENS:
            yield from self.plan(last=False)

    def plan(self, last: bool) -> Iterator[tuple]:
        """The pieces of all windows but the last few, which are planned again with what follows."""
        if not self.ids:
            return
        lengths = np.array([len(x) for x in self.ids], np.int64)
        stream = np.concatenate(self.ids)
        cuts = cut(*cut_points(lengths, self.tokens.ends[stream], self.capacity), self.capacity)
        cuts = cuts if last else cuts[:-REPLANNED]
        bounds = np.cumsum(lengths)
        document, begin = 0, 0
        for end in cuts:
            at = begin
            while at < end:
                stop = min(end, int(bounds[document]))
                start = self.starts[document] + at - (int(bounds[document]) - int(lengths[document]))
                crc = zlib.crc32(stream[at:stop].astype("<u4").tobytes())
                yield self.keys[document], start, stop - at, crc, self.totals[document], self.sequence, at - begin
                at = stop
                document += stop == bounds[document]
            begin, self.sequence = end, self.sequence + 1
        rest = begin - (int(bounds[document]) - int(lengths[document])) if document < len(lengths) else 0
        self.keys, self.totals, self.ids, self.starts = self.keys[document:], self.totals[document:], self.ids[document:], self.starts[document:]
        if rest:
            self.ids[0] = self.ids[0][rest:]
            self.starts[0] += rest
        self.held = sum(map(len, self.ids))


_TOKENS: dict[str, Tokens] = {}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cuts the token stream of each partition into sequences of at most capacity tokens, documents in stored order.

    A document is its ids followed by end_id. A window ends at a document's end for nothing, after a sentence at the price
    of SENTENCE_CUT tokens of padding, elsewhere at that of HARD_CUT; the cuts cost least together, planned PLAN_TOKENS
    at a time. There is no shuffle: a partition is packed by itself, which leaves at most one short sequence a partition, and
    a retried task gives the same rows. Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    (partition number times 2^33, counted up) and offset.

    A null or empty text is one token, a null doc_id stays null, repeated rows are packed each by itself, a text of any
    length is cut as often as needed, and an empty table gives an empty result. Other columns are left out.
    """
    key = free_column(docs, "_key")
    narrow = docs.select(F.col(id_column).cast("long").alias(key), F.col(text_column).alias("text"))
    kinds = {"doc_id": LongType, "start": LongType, "length": LongType, "ids_crc32": LongType, "doc_tokens": LongType, "sequence_id": LongType, "offset": LongType}
    schema = StructType([StructField(n, k()) for n, k in kinds.items()])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get(vocabulary) or _TOKENS.setdefault(vocabulary, Tokens(vocabulary))
        packer, pieces = Packer(tokens, capacity, end_id, TaskContext.get().partitionId() << 33), []

        def batch():
            columns = [pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)]
            pieces.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(kinds))

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                pieces.extend(packer.add(keys[i].as_py(), texts[i].as_py()))
                if len(pieces) >= 20_000:
                    yield batch()
        pieces.extend(packer.plan(last=True))
        if pieces:
            yield batch()

    return narrow.mapInArrow(packed, schema)


def op9_ordered_packing(spark, sf_dir):
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


__all__ = ["Packer", "Tokens", "cut", "cut_points", "op9_ordered_packing", "pack"]
