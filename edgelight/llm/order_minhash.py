"""Fingerprints that follow edit distance: Order MinHash, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_column

#: Words in a k-mer, tuples in a fingerprint (one ordering each), circles of ranks that the orderings follow, k-mers in a tuple,
#: hexadecimal digits per tuple.
K, TUPLES, CIRCLES, MEMBERS, DIGITS = 4, 64, 4, 2, 6
#: Low bits of a ranked k-mer that hold its position, as many as an array can have; the other 33 are its rank.
POSITION_BITS = 31
#: Orderings of a circle, and the high bits of a rank that say after which of their starting points it lies.
POINTS = TUPLES // CIRCLES
ARC_BITS = POINTS.bit_length() - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: an expression in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def kmers(text: Column, k: int) -> Column:
    """Hashes of all k consecutive words; of all words as one where there are fewer."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def grams(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[at(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def where_new(array: Column, value: Callable[[Column], Column]) -> Column:
    """The indices at which value differs from that of the element before, the first among them."""
    indices = F.transform(array, lambda x, i: F.when((i == 0) | (value(x) != value(at(array, i - 1))), i))
    return F.filter(indices, lambda i: i.isNotNull())


def ranked(hashes: Column) -> Column:
    """For each k-mer a long: 33 bits that its hash and its occurrence number fix together, then its position.

    Where k-mers repeat, equal ones stand together once sorted by hash and position, and the distance from the first of its
    run is the occurrence number.
    """

    def one(h: Column, number: Column, position: Column) -> Column:
        return F.xxhash64(h, number).bitwiseAND(F.lit(-(1 << POSITION_BITS)).cast("long")).bitwiseOR(position.cast("long"))

    def numbered(s: Column) -> Column:
        def from_first(firsts: Column) -> Column:
            runs = F.transform(firsts, lambda f, j: F.array_repeat(f, F.coalesce(at(firsts, j + 1), F.size(s)) - f))
            return let(F.flatten(runs), lambda first: F.transform(s, lambda x, i: one(x["h"], i - at(first, i), x["p"])))

        return let(where_new(s, lambda x: x["h"]), from_first)

    several = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), numbered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda h, i: one(h, F.lit(0), i))).otherwise(several)


def ranked_anew(ranks: Column, circle: int) -> Column:
    """Ranks of another circle for the same k-mers, each with its position."""
    low = F.lit((1 << POSITION_BITS) - 1)
    return F.transform(ranks, lambda x: F.xxhash64(F.shiftright(x, POSITION_BITS), F.lit(circle)).bitwiseAND(F.lit(-(1 << POSITION_BITS)).cast("long")).bitwiseOR(x.bitwiseAND(low)))


def fingerprint(text: Column, k: int = K) -> Column:
    """TUPLES hashes (long; all null for a text without words) of the tuples that represent the word order of a text.

    An ordering of the occurrence-numbered k-mers follows ranks around a circle from a starting point of its own; there are CIRCLES
    circles with ranks of their own, and POINTS such points at equal distances on each. In each ordering the MEMBERS smallest k-mers
    are chosen (all, if there are fewer), put in text order and hashed together. So a tuple of two texts agrees if they choose the same
    k-mers in the same order. The ranks of a circle are sorted once, and what an ordering chooses stands side by side. Texts of any
    length have the same orderings, so that all fingerprints can be compared.
    """

    def arc(x: Column) -> Column:
        return (F.shiftright(x, 64 - ARC_BITS) + F.lit(POINTS // 2)).cast("int")

    def tuples(hashes: Column, b: Column) -> Column:
        def starts(heads: Column) -> Column:
            up_to = F.transform(heads, lambda i, j: F.array_repeat(i, arc(at(b, i)) - F.coalesce(arc(at(b, at(heads, j - 1))), F.lit(-1))))
            return F.concat(F.flatten(up_to), F.array_repeat(F.lit(0), F.lit(POINTS - 1) - arc(at(b, F.size(b) - 1))))

        def joined(i: Column) -> Column:
            steps = F.sequence(F.lit(0), F.least(F.lit(MEMBERS), F.size(b)) - 1)
            places = F.transform(steps, lambda j: at(b, (i + j) % F.size(b)).bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))
            return F.xxhash64(F.transform(F.sort_array(places), lambda p: at(hashes, p))).bitwiseAND(F.lit((1 << (4 * DIGITS)) - 1))

        return F.transform(let(where_new(b, arc), starts), joined)

    none = F.array_repeat(F.lit(None).cast("long"), TUPLES)

    def of_all_circles(hashes: Column, ranks: Column) -> Column:
        return F.concat(*[let(F.sort_array(ranked_anew(ranks, c) if c else ranks), lambda b: tuples(hashes, b)) for c in range(CIRCLES)])

    return let(kmers(text, k), lambda hashes: F.when(F.size(hashes) == 0, none).otherwise(let(ranked(hashes), lambda ranks: of_all_circles(hashes, ranks))))


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.when(x.isNull(), F.lit("-" * DIGITS)).otherwise(F.lower(F.lpad(F.hex(x), DIGITS, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of tuples that agree among those that either has; of two empty ones 1."""
    agree = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"]))
    either = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].isNotNull() | z["b"].isNotNull()))
    return F.when(either > 0, agree / either).otherwise(1.0).cast("double")


def with_next(docs: DataFrame, id_column: str, text_column: str, buckets: int) -> DataFrame:
    """(bucket, ghost, key, doc_id, text, next_text): each document with the next one's text, by descending id, the last with the first's.

    Ranges of ids are buckets, and each gets a copy of the first document of the next one as a ghost at its end. So every
    look at the next row stays in a bucket. The driver sees one id per bucket. A null text is an empty one, a null id comes last,
    rows that share an id follow each other by a hash of their texts; the next of a single document is itself, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / buckets for i in range(buckets - 1)], 100 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda c: c < F.col("key"))))
    firsts = sorted(((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("first")).collect()), reverse=True)
    ghosts = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    ghosts = docs.sparkSession.createDataFrame(ghosts, "ghost_key long, ghost_bucket int")
    copies = rows.join(F.broadcast(ghosts), F.col("key") == F.col("ghost_key")).select("doc_id", "text", "key", F.col("ghost_bucket").alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.select("doc_id", "text", "key", "bucket", F.lit(False).alias("ghost")).unionByName(copies)
    return both.withColumn("next_text", F.lead("text").over(descending()))


def descending() -> Window:
    return Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("key").desc(), F.xxhash64("text"))


def order_minhash(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, name: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint (array<long>) per text; equal texts have equal fingerprints.

    A null text counts as empty; a text without words has no tuples, only nulls; fewer than k words are one k-mer. Nothing is
    shuffled: repeated rows, null ids and an empty table need no care, and all columns stay.
    """
    return docs.withColumn(free_column(docs, name), fingerprint(F.coalesce(F.col(text_column), F.lit("")), k))


def op6_order_minhash(spark, sf_dir):
    docs = documents(spark, sf_dir)
    buckets = min(2048, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(docs, "doc_id", "text", buckets)
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, n_chars - n_chars div 2)"), F.expr("left(next_text, n_chars div 2)")))
    rows = rows.withColumns({"fp": fingerprint(F.col("text")), "edited_fp": F.when(~F.col("ghost"), fingerprint(F.col("edited")))})
    rows = rows.withColumn("next_fp", F.lead("fp").over(descending())).where(~F.col("ghost"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
