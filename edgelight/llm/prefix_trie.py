"""A trie of conversations by their first turns, built by prefix doubling: names for blocks of 1, 2, 4 ... turns, then for prefixes, then nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_column, global_rank, named, scratch, staged, word_count
from .sharding import numbered

NO_ENDS = hashlib.sha256(b"").hexdigest()


def distinct_names(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """rows with a dense number from 0 for each distinct value of keys, staged. Only distinct values are numbered; the rows then look theirs up.

    Numbers are dealt by bucket, so that the look-up joins two plain exchanges and Spark can split a value that very many rows have.
    """
    found = staged(rows.select(*keys).distinct())
    return staged(rows.join(numbered(found, [F.col(k) for k in keys], name), keys))


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, place, role, digest, words) and conversations as (conv_id, start, turns); both are staged.

    place numbers all rows by conversation, turn (null first), role and the SHA-256 of the text, so that a conversation spreads over ranges
    however long it is; the place in its conversation is place - start. Rows that agree in all of these are alike in either order.
    """
    salt = free_column(conversations, "_row")
    rows = named(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), word_count(text).alias("words"), F.monotonically_increasing_id().alias(salt))
    ranked = global_rank(rows, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc(salt)], "place")
    ranked = ranked.select("conv_id", "place", "role", "digest", "words")
    return ranked, staged(ranked.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("turns")))


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, position, role, digest, words) and, for each conv_id, (conv_id, turns), which may be 0.

    Conversation c takes the first h turns of conversation c - c % family, as far as there are so many, and then its own without its first h;
    h is crc32 of c's decimal digits, modulo most. Rows with a null conv_id are left out; null roles and texts are empty ones.
    """
    with scratch() as keep:
        rows, convs = ordered_turns(conversations)
        c = F.col("conv_id")
        heads = convs.select(c, "start", "turns", (c - c % family).alias("base"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).alias("h"))
        bases = convs.select(c.alias("base"), F.col("turns").alias("base_turns"))
        heads = staged(heads.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))))
        placed = rows.join(convs.select("conv_id", "start"), "conv_id").withColumn("at", F.col("place") - F.col("start"))
        first = placed.where(F.col("at") < most).select(F.col("conv_id").alias("base"), F.col("at").alias("position"), "role", "digest", "words")
        taken = heads.select("conv_id", "base", "taken").join(first, "base").where("position < taken").select("conv_id", "position", "role", "digest", "words")
        own = rows.join(heads.select("conv_id", "start", "h", "taken"), "conv_id").withColumn("at", F.col("place") - F.col("start"))
        own = own.where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("position"), "role", "digest", "words")
        turns = keep(staged(taken.unionByName(own)))
        lengths = keep(staged(heads.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("turns"))))
        return turns, lengths


@dataclass(frozen=True)
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. members: (member, depth, conv_id), the node of
    each prefix of each conversation. A node is told by its smallest member and its depth."""

    nodes: DataFrame
    members: DataFrame


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Level k: (conv_id, j, name) for each whole block of 2**k turns from turn j * 2**k on; equal blocks have equal names. The lowest has words as well."""
    lowest = distinct_names(turns.select("conv_id", F.col("position").alias("j"), "role", "digest", "words"), ["role", "digest"])
    out = [lowest.select("conv_id", "j", "name", "words")]
    while 1 << len(out) <= longest:
        half = F.pmod("j", F.lit(2))
        pairs = out[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        out.append(distinct_names(pairs.where("right is not null"), ["left", "right"]).select("conv_id", "j", "name"))
    return out


def _prefixes(blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name) for each prefix, whose names are equal where depth and turns are; staged.

    A prefix is what is left of it without its last block, which is as long as the lowest bit of depth, and that block: prefixes of one
    block have its name, those of m blocks are named in round m by the prefix of m - 1 blocks and the last block.
    """
    last = [b.where("j % 2 = 0").select("conv_id", (F.col("j") * (1 << k)).alias("head"), F.lit(1 << k).cast("long").alias("size"), "name") for k, b in enumerate(blocks)]
    last = staged(reduce(DataFrame.unionByName, last))  # read in each round
    out = [last.where("head = 0").select("conv_id", F.col("size").alias("depth"), "name")]
    for m in range(1, len(blocks)):
        ends = last.where(F.bit_count("head") == m).withColumnRenamed("name", "block")
        before = out[-1].select("conv_id", F.col("depth").alias("head"), F.col("name").alias("before"))
        named_rows = distinct_names(ends.join(before, ["conv_id", "head"]).select("conv_id", (F.col("head") + F.col("size")).alias("depth"), "before", "block"), ["depth", "before", "block"])
        out.append(named_rows.select("conv_id", "depth", "name"))
    return staged(reduce(DataFrame.unionByName, out))


def _runs(batches: Iterator) -> Iterator:
    """Sorted (conv_id, depth, member) as one text for each node in a batch: its members, joined by commas."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        node, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
        starts = [0, *((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])).nonzero()[0] + 1, len(node)]
        texts = [",".join(map(str, member[a:b].tolist())) for a, b in zip(starts, starts[1:], strict=False)]
        at = starts[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(member[at]), pa.array(texts)], names=["conv_id", "depth", "first", "said"])


def _digests(batches: Iterator) -> Iterator:
    """Sorted runs as one digest for each node; only the state of one digest is held."""
    import pyarrow as pa

    def row(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    key, digest = None, None
    for batch in batches:
        done = []
        for node, depth, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "said")), strict=True):
            if key == (node, depth):
                digest.update(f",{said}".encode())
                continue
            if key is not None:
                done.append(row(key, digest))
            key, digest = (node, depth), hashlib.sha256(said.encode())
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
    if key is not None:
        yield row(key, digest)


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the SHA-256 of the members that end in a node, ascending, joined by commas.

    Members are sorted over ranges, which join them to texts of a batch each; a node's texts then go through one digest in their order, as SHA-256
    asks for, in bounded memory.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ends.repartitionByRange(parts, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(_runs, "conv_id long, depth long, first long, said string")
    ordered = runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return ordered.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of all conversations.

    turns: conv_id, position (from 0, without gaps), role, digest (of the text) and words; lengths: conv_id and turns, also for conversations
    without any. Names are given in a logarithmic number of rounds in the longest conversation, and so are sums over subtrees: in round k each
    node passes what it has gathered to its ancestor 2**k levels up, which it finds as a prefix of its own smallest member. All tables are keyed by
    conversation and turn or by node, so that no round gathers the members of a node in a task. Without conversations there is no node, not even a root.
    """
    with scratch() as keep:
        whole = lengths.agg(F.max("turns").alias("longest"), F.min("conv_id").alias("root")).first()
        longest, root = whole["longest"] or 0, F.lit(whole["root"]).cast("long")
        empty = lengths.select(F.col("conv_id").alias("member"), F.lit(0).cast("long").alias("depth"), root.alias("conv_id"))
        if longest:
            blocks = _blocks(turns, longest)
            named_rows = _prefixes(blocks)
            smallest = staged(named_rows.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")))
            members = named_rows.join(smallest, ["depth", "name"]).select(F.col("conv_id").alias("member"), "depth", F.col("node").alias("conv_id"))
            members = keep(staged(members.unionByName(empty)))
            words = blocks[0].select(F.col("conv_id").alias("node"), (F.col("j") + 1).alias("depth"), "words")
            nodes = smallest.join(words, ["node", "depth"]).select(F.col("node").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
        else:
            members = keep(staged(empty))
            nodes = lengths.limit(0).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
        top = lengths.agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.lit(0).cast("long").alias("saved")).where("conv_id is not null")
        nodes = nodes.unionByName(top)

        def ancestors(of: DataFrame, up: int) -> DataFrame:
            """of with the smallest member of each node's ancestor so many levels up, as above; nodes that are not so deep are left out."""
            path = members.select(F.col("member").alias("conv_id"), (F.col("depth") + up).alias("depth"), F.col("conv_id").alias("above"))
            return of.where(F.col("depth") >= up).join(path, ["conv_id", "depth"])

        parents = ancestors(nodes.where("depth > 0"), 1).select("conv_id", "depth", F.col("above").alias("parent_conv_id"))
        children = parents.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = nodes.join(parents, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        nodes = staged(nodes)
        sums = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        up = 1
        while up <= longest:
            passed = ancestors(sums, up).select(F.col("above").alias("conv_id"), (F.col("depth") - up).alias("depth"), "n_leaves", "saved_tokens")
            added = staged(sums.unionByName(passed).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
            sums, up = added, up * 2
        ends = members.join(lengths.select(F.col("conv_id").alias("member"), F.col("turns").alias("depth")), ["member", "depth"]).select("conv_id", "depth", "member")
        out = nodes.drop("saved").join(sums, ["conv_id", "depth"]).join(end_digests(ends), ["conv_id", "depth"], "left")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        return Trie(keep(staged(out.select(*columns, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))), members)


def op13_prefix_trie(spark, sf_dir):
    with scratch() as keep:
        turns, lengths = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
        return keep(prefix_trie(turns, lengths).nodes)
