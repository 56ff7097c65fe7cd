"""Documents that the operators must stand, and plain versions of what they compute."""

import collections
import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode())


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def table():
    """Nulls, empty and white-space texts, one word, copies, near copies, a shared passage, repeated lines, a long text,
    repeated rows, one id with two texts, and code points of one to four bytes."""
    base, passage, long_ = prose(300, 1), prose(60, 2), prose(30_000, 3, 100_000)
    near = base.split(" ")
    near[150] = "changed"
    texts = [
        None, "", " \n\t ", "word", "Two Words", "two words", base, base, base.upper(), " ".join(near), prose(40, 4) + " " + passage + " tail", passage + " " + prose(50, 5),
        "same line here again and again\n" * 40, long_, long_[1000:90_000], "日本語 テスト 😀 " * 30, "日本語 テスト 😀 " * 30 + "x", prose(35, 6), prose(35, 6), prose(36, 6)[1:], prose(500, 7), prose(500, 7),
    ]
    rows = [(i * 3, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (18, passage, "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(table() if rows is None else rows, SCHEMA)


def link_components(sets, linked):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                parent[root(a)] = root(b)
    return [root(i) for i in range(len(sets))]


def near_components(rows, percent=75):
    """{id: (set size, component)} for rows whose ids are unique."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    roots = link_components(sets, lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    smallest = {}
    for (k, _), r in zip(rows, roots, strict=True):
        smallest[r] = min(k, smallest.get(r, k))
    return {k: (len(s), smallest[r]) for (k, _), s, r in zip(rows, sets, roots, strict=True)}


def covered_bytes(rows, width=50):
    """Per row: which bytes are covered by a string that also starts in a row with a smaller id."""
    first = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(k, first.get(w, k))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        out.append((b, gone))
    return out


def byte_digest(b, gone):
    spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
    return len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def word_digests(rows, width=35):
    """Per row: words, words removed, digest of the kept ones."""
    lists = [words(t) for _, t in rows]
    count = collections.Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
