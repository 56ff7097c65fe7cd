"""Near-duplicate documents: banded MinHash candidates, odd sketches to weed them out, full sets to confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import connected_components, discard, documents, staged
from .hashing import U64, constants, mix64, shingles
from .repeats import row_key, slices, text_columns

#: At a similarity of 0.75 all 32 bands of four samples miss a pair with probability 5e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Five standard deviations of the estimate below the threshold that is asked for.
ESTIMATE_SLACK = 0.2
#: Members of a bucket, and shingles of them in all, that one side of a comparison between components holds at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22

_MULTIPLIERS = constants(SAMPLES, 5)


def minhash(items: np.ndarray) -> np.ndarray:
    """SAMPLES minima over items, each under a multiplication of its own."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 1024):
            np.minimum(best, (items[i : i + 1024, None] * _MULTIPLIERS).min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> bytes:
    """A bitmap in which each sample flips one bit: equal samples of two documents cancel out under XOR."""
    with np.errstate(over="ignore"):
        at = mix64(samples + np.arange(len(samples), dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def most_flips(threshold: float) -> int:
    """The population count of the XOR of two odd sketches beyond which the estimated similarity is under threshold less the slack.

    With m samples and n bits, J = 1 + n / (4 m) * ln(1 - 2 * flips / n), solved for flips.
    """
    j = max(0.0, threshold - ESTIMATE_SLACK)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - j) / SKETCH_BITS))))


def signatures(docs: DataFrame) -> DataFrame:
    """(key, id, n_shingles, set_hash, bands, sketch) per row of (key, text as bytes, id); without words n_shingles is 0 and the rest null."""
    schema = "key long, id long, n_shingles long, set_hash string, bands array<long>, sketch binary"
    band_mix = constants(ROWS, 6)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, data, offsets = text_columns(batch)
            n, hashes, bands, sketches = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for i in range(batch.num_rows):
                items = shingles(data[offsets[i] : offsets[i + 1]])
                n[i] = len(items)
                if not len(items):
                    continue
                samples = minhash(items)
                with np.errstate(over="ignore"):
                    keys = mix64((samples.reshape(BANDS, ROWS) * band_mix).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
                hashes[i], bands[i], sketches[i] = hashlib.blake2b(items.tobytes(), digest_size=16).hexdigest(), keys.view(np.int64), odd_sketch(samples)
            columns = [batch.column(0), batch.column(2), pa.array(n), pa.array(hashes, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n_shingles", "set_hash", "bands", "sketch"])

    return docs.select("key", F.col("text").cast("binary").alias("text"), "id").mapInArrow(signed, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    @F.pandas_udf(BooleanType())
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, mine = [], None, None
        for a, b in zip(left, right, strict=True):
            if a is not last:
                last, mine = a, shingles(a)
            other = shingles(b)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            out.append(100 * both >= percent * (len(mine) + len(other) - both))
        return pd.Series(out, dtype=bool)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(similar("text_a", "text_b")).select("a", "b")


def sketched(pairs: DataFrame, sketches: DataFrame, flips: int) -> DataFrame:
    """The pairs whose odd sketches differ in at most so many bits."""

    @F.pandas_udf(BooleanType())
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), U64).reshape(len(x), -1) for x in (left, right))
        return pd.Series(np.bitwise_count(a ^ b).sum(axis=1) <= flips)

    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").where(close("sketch_a", "sketch_b")).select("a", "b")


def contested(members: DataFrame, sketches: DataFrame, flips: int) -> DataFrame:
    """(key, i, j, id, component, mine): members (key, id, leader, n_shingles, component) of one bucket whose full sets must be compared.

    Only buckets of several components count, and in them only pairs without the leader, which has been compared with all. A
    bucket is cut into blocks of at most BLOCK members and BLOCK_SHINGLES shingles, and a task looks at two blocks (i, j). A
    pair counts if its components differ, its sketches are close and no earlier band has brought it together; the pairs
    themselves stay in the task, which names the members that have one.
    """
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high and n > 2")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    open_keys = open_keys.select(F.col("key").alias("open_key"), blocks.alias("blocks"))
    rows = members.where("id <> leader").join(open_keys, F.col("key") == F.col("open_key")).select("key", "id", "component", "blocks")
    rows = rows.join(sketches.select(F.col("id").alias("of"), "sketch", "bands"), F.col("id") == F.col("of")).drop("of")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "component", "mine", "sketch", "bands")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "i", "j", "id", "component", "mine"]
        left, right = (group[group["mine"] == group[side].iloc[0]] for side in ("i", "j"))
        if not len(left) or not len(right):
            return group[columns].head(0)
        (sa, ba), (sb, bb) = ((np.frombuffer(b"".join(x["sketch"]), U64).reshape(len(x), -1), np.stack(x["bands"].to_list())) for x in (left, right))
        near = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        for band in range(int(np.flatnonzero(ba[0] == group["key"].iloc[0])[0])):
            near &= ba[:, band][:, None] != bb[:, band][None, :]
        apart = np.zeros(near.shape, np.uint16)
        for word in range(sa.shape[1]):
            apart += np.bitwise_count(sa[:, word][:, None] ^ sb[:, word][None, :])
        near &= apart <= flips
        return pd.concat([left[near.any(axis=1)], right[near.any(axis=0)]])[columns].drop_duplicates("id")

    return rows.groupBy("key", "i", "j").applyInPandas(meet, "key long, i int, j int, id long, component long, mine int")


def common_items(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of each set of left with each of right: products of 0/1 matrices, width items at a time."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, flat)
        inside = np.flatnonzero((at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == flat)) if len(both) else np.zeros(0, np.int64)
        inside = inside[np.argsort(at[inside], kind="stable")]
        sides.append((row[inside], at[inside]))
    out = np.zeros((len(left), len(right)))
    for low in range(0, len(both), width):
        parts = []
        for sets, (row, at) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            dense = np.zeros((len(sets), min(width, len(both) - low)), np.float32)
            dense[row[a:b], at[a:b] - low] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def joined_components(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that the full sets of two contested members link; per task as few as join what it has found to belong together."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["mine"] == group[side].iloc[0]] for side in ("i", "j"))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        (ca, sa), (cb, sb) = ((x["component"].to_numpy(), [shingles(t) for t in x["text"]]) for x in (left, right))
        both = common_items(sa, sb)
        union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (ca[:, None] != cb[None, :]))
        pairs = np.unique(np.column_stack([np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y])]), axis=0)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        kept = []
        for a, b in pairs.tolist():
            low, high = sorted((root(a), root(b)))
            if low != high:
                parent[high] = low
                kept.append((a, b))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    texts = texts.select(F.col("id").alias("of"), "text")
    rows = members.join(texts, F.col("id") == F.col("of")).select("key", "i", "j", "component", "mine", "text")
    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| over their sets of five-word shingles.

    Equal sets are one representative. Representatives that share a band of MinHash samples are candidates.
    First each is compared with one leader of its bucket only; what that links is one component and needs no further
    comparison inside it. Then members of one bucket in different components are compared, block by block and each pair in the
    first band that brings it together. Odd sketches drop the pairs that are clearly below the threshold, the full sets of whole texts
    decide on the rest. Pairs never leave a task: it returns the components that it joins. No bucket is capped.

    Returns key (row_key: rows that share an id are told apart by their text), id, n_shingles, component (smallest id reachable) and
    keeper (the key of the row that stands for the component: of its rows with that id the one with the smallest key). Rows with a
    null or wordless text have no shingles and are alone; a null id is kept, as its own component. Rows that repeat an id and a text
    have one key. An empty table gives an empty result. Other columns are left out.
    """
    flips = most_flips(percent / 100)
    rows = docs.select(row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"), F.col(id_column).cast("long").alias("id"))
    signed = staged(signatures(rows))
    real = signed.where("set_hash is not null and id is not null")
    # In what follows a set is named by the key of one of its rows.
    sets = staged(real.groupBy("set_hash").agg(F.min("key").alias("node"), F.min(F.struct("id", "key")).alias("first")))
    named = sets.select("node", F.col("set_hash").alias("of"))
    reps = real.join(named, (F.col("set_hash") == F.col("of")) & (F.col("key") == F.col("node"))).dropDuplicates(["node"])
    reps = staged(reps.select(F.col("node").alias("id"), "n_shingles", "bands", "sketch"))
    sketches = reps.select("id", "sketch", "bands")
    bands = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("led"), "leader")
    members = staged(bands.join(leaders, F.col("key") == F.col("led")).select("key", "id", "leader", "n_shingles"))
    stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    # Only texts of candidates are compared; they are set apart once, so that later joins move no others.
    candidates = members.select(F.col("id").alias("candidate")).distinct()
    texts = staged(rows.select(F.col("key").alias("id"), "text").join(candidates, F.col("id") == F.col("candidate"), "left_semi"))
    links = staged(confirmed(sketched(stars, sketches, flips), texts, percent))
    nodes = members.select(F.col("id").alias("node")).distinct()
    found = staged(connected_components(nodes, links))
    placed = members.join(found, F.col("id") == F.col("node")).select("key", "id", "leader", "n_shingles", "component")
    rivals = staged(contested(placed, sketches, flips))
    joins = staged(joined_components(rivals, texts, percent))
    discard(reps, members, texts, links, rivals)
    ends = joins.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lower = connected_components(ends, joins).select(F.col("node").alias("was"), F.col("component").alias("lowest"))
    found = found.join(lower, F.col("component") == F.col("was"), "left").select("node", F.coalesce("lowest", "component").alias("component"))
    reached = sets.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("set_hash", "first", F.coalesce("component", "node").alias("component"))
    smallest = reached.groupBy("component").agg(F.min("first").alias("first")).withColumnRenamed("component", "of")
    reached = reached.join(smallest.withColumnRenamed("first", "smallest"), F.col("component") == F.col("of")).select(F.col("set_hash").alias("of"), "smallest")
    out = signed.join(reached, (F.col("set_hash") == F.col("of")) & F.col("id").isNotNull(), "left")
    return out.select("key", "id", "n_shingles", F.coalesce("smallest.id", "id").alias("component"), F.coalesce("smallest.key", "key").alias("keeper"))


def op4_odd_sketch_near_dup(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
