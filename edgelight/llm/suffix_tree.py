"""Exact removal of repeated word sequences with suffix trees over prefix groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, free_column
from .repeats import Entries, Kind, merged, repeated_windows, runs, window_runs, with_spans

#: Words of an anchor (see repeats), and suffixes of a prefix group, whose subtree is built at once.
ANCHOR, GROUP = 8, 1 << 16
_WORDS = re.compile(WORD.encode())


def prefix_groups(words: np.ndarray, suffix: np.ndarray, depth: int = 0, width: int = 35, limit: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Suffixes in groups of at most limit: (suffixes, the number of the prefix of each, the prefixes' length in words).

    A prefix that too many suffixes share is lengthened by a word, and again where that is not enough; prefixes of few suffixes
    travel together. Where all width words agree there is nothing to lengthen, and a group is a single node however large.
    """
    if len(suffix) <= limit or depth >= width:
        yield suffix, np.zeros(len(suffix), np.int64), depth
        return
    order = np.argsort(words[suffix + depth], kind="stable")
    suffix = suffix[order]
    head = runs(words[suffix + depth])
    size = np.diff(np.append(head, len(suffix)))
    small = np.repeat(size <= limit, size)
    for i in np.flatnonzero(size > limit):
        yield from prefix_groups(words, suffix[head[i] : head[i] + size[i]], depth + 1, width, limit)
    number, size = np.repeat(np.arange(len(size)), size)[small], size[size <= limit]
    suffix, low, total = suffix[small], 0, np.cumsum(size)
    while low < len(suffix):
        high = int(total[np.searchsorted(total, low + limit, "right") - 1])
        yield suffix[low:high], number[low:high], depth + 1
        low = high


def subtree(words: np.ndarray, room: np.ndarray, weight: np.ndarray, suffix: np.ndarray, prefix: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The deep internal nodes of the suffix tree below some prefixes: those at a depth of width words or more with none such above.

    Returns the suffixes below them, node by node, where each node's begin, and each node's depth. A node's suffixes part by
    the next words, as many as fit into a number; one left alone is a leaf and done. What is together at depth width is below one
    deep node, and its edge goes on for as long as all its suffixes agree: the node's string is a maximal repeat. A string that
    stands for several equal ones has that many leaves for each suffix (weight), so that one such suffix makes a node.
    """
    each = max(1, 62 // max(1, int(words.max(initial=0)).bit_length()))
    inner = np.bincount(prefix, weight[suffix], 1)[prefix] > 1
    suffix, prefix = suffix[inner], prefix[inner]
    while depth < width and len(suffix):
        step = min(each, width - depth)
        label = np.zeros(len(suffix), np.int64)
        for j in range(depth, depth + step):
            label = (label << (62 // each)) | words[suffix + j]
        order = np.lexsort((label, prefix))
        suffix, prefix, label = suffix[order], prefix[order], label[order]
        new = np.ones(len(suffix), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (label[1:] != label[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(suffix)))
        inner = np.repeat(np.add.reduceat(weight[suffix], head) > 1, size)
        suffix, prefix = suffix[inner], np.repeat(np.arange(len(head)), size)[inner]
        depth += step
    first = runs(prefix)
    size = np.diff(np.append(first, len(suffix)))
    depths = np.full(len(first), depth)
    going = np.arange(len(first))
    while len(going):
        rows = np.repeat(first[going], size[going]) + np.arange(size[going].sum()) - np.repeat(np.cumsum(size[going]) - size[going], size[going])
        x, edges = suffix[rows], np.cumsum(size[going]) - size[going]
        inside = room[x] > depth
        following = np.where(inside, words[np.minimum(x + depth, len(words) - 1)], -1)
        agree = np.logical_and.reduceat(inside, edges) & (np.minimum.reduceat(following, edges) == np.maximum.reduceat(following, edges))
        going = going[agree]
        depth += 1
        depths[going] = depth
    return suffix, first, depths


def deep_nodes(words: np.ndarray, bounds: np.ndarray, width: int, limit: int = GROUP, owners: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What subtree() returns for each group of prefixes of some strings of words (as numbers), which bounds part; owners: how many equal
    strings each stands for, one if not given."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    weight = np.ones(len(words), np.int64) if owners is None else np.repeat(owners, np.diff(bounds))
    for group in prefix_groups(words, np.flatnonzero(room >= width), 0, width, limit):
        yield subtree(words, room, weight, *group, width)


def repeated_anywhere(width: int):
    """A finder: windows that start anywhere else as well, which are those below the deep nodes."""

    def find(entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nodes = deep_nodes(entries.text.astype(np.int64), entries.bounds, width, owners=entries.owners)
        suffix = np.concatenate([np.zeros(0, np.int64), *[s for s, _, _ in nodes]])
        entry = np.searchsorted(entries.bounds, suffix, "right") - 1
        return window_runs(entry, suffix - entries.bounds[entry], np.ones(len(entry), bool))

    return find


def repeated_spans(docs: DataFrame, width: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(uid, id, spans): the windows of width words of each document that also start anywhere else, in it or in another."""
    return repeated_windows(docs, Kind(words=True, width=width, gram=min(ANCHOR, width), earlier=False), repeated_anywhere(width), id_column, text_column)


def dedup_words(docs: DataFrame, width: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words outside all windows of width words that also start elsewhere.

    Words are longest runs without space and the control characters 9 to 13, unchanged; kept words are joined by one space.
    Every copy of a repeat goes, the first as well. A null text has no words and an empty kept_text, as has a text that is
    white space; texts of fewer than width words and rows with a null id only lose the white space between words. Rows that
    share an id are told apart by their text, so that repeats between them count, and rows that repeat an id and a text repeat
    each other. An empty table gives an empty result; all columns stay, and an added name that docs has already gets underscores
    in front.
    """
    spans = free_column(docs, "_spans")
    found = repeated_spans(docs, width, id_column, text_column)
    names = [free_column(docs, n) for n in ("n_words", "n_removed", "kept_text")]

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, s in zip(texts, spans, strict=True):
            words, gone = _WORDS.findall((text or "").encode()), merged(s, width)
            edge = [0, *gone.ravel().tolist(), len(words)]
            kept = [w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    joined = with_spans(docs, found, spans, id_column, text_column)
    done = free_column(joined, "_cut")
    joined = joined.withColumn(done, cut(F.col(text_column), F.col(spans)))
    return joined.select(*docs.columns, *[F.col(done)[c].alias(n) for c, n in zip(("n_words", "n_removed", "kept_text"), names, strict=True)])


def op5_suffix_tree_dedup(spark, sf_dir):
    out = dedup_words(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["dedup_words", "deep_nodes", "prefix_groups", "subtree", "op5_suffix_tree_dedup", "repeated_spans"]
