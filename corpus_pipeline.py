"""From documents to packed training sequences: drop toxic and near-duplicate documents, cut repeats, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it again for the next stage. All but the last return the columns of documents, in their order, whatever these are called: columns
beyond doc_id, text, source and n_chars pass through as they are. An empty table gives an empty result in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgelight.llm import mixing, near_dup, packing, suffix_array, toxicity
from edgelight.llm.common import bounded_batches, discard, documents, free_column, staged
from edgelight.llm.repeats import row_key

#: Which tokens the last stage packs, and how many to a sequence.
VOCABULARY, SEQUENCE = "byte_bpe_50k.json", 2048


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier chain, fitted on those with labels, does not call toxic.

    Null and empty texts stay, as do rows with a null id; equal texts go or stay together, repeated rows each for itself.
    """
    bounded_batches(spark)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.categories())
    flag = toxicity.score_columns(docs, chain.names)["is_toxic"]
    return toxicity.score(docs, chain).where(~F.col(flag)).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id (of texts that share it, one).

    Of rows that repeat an id and a text one stays. Null, empty and wordless texts are like no other and stay, once an id; so
    do all rows with a null id.
    """
    bounded_batches(spark)
    groups = near_dup.near_duplicates(docs)
    key, nth, keeper = (free_column(docs, c) for c in ("_key", "_nth", "_keeper"))
    keepers = groups.where("key = keeper and id is not null").select(F.col("key").alias(keeper)).distinct()
    kept = docs.where("doc_id is not null").withColumn(key, row_key("doc_id", "text")).join(keepers, F.col(key) == F.col(keeper), "left_semi")
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))).where(F.col(nth) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes and more that a smaller doc_id has as well; documents of which nothing is left go.

    n_chars follows the text. Null and empty texts stay, as do the texts of rows with a null id; rows of one id do not affect each other.
    """
    bounded_batches(spark)
    text, removed = (free_column(docs, c) for c in ("kept_text", "removed"))
    cut = suffix_array.dedup_bytes(docs).where(F.col("text").isNull() | (F.col("text") == "") | (F.col(text) != ""))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(removed) > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents in whole repetitions, and the fraction that is left over.

    A null source is one like others. A null or wordless text has no words: it comes as often as its source's whole repetitions.
    """
    bounded_batches(spark)
    return mixing.repeated(mixing.mix(docs), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: each token of each row is in one. A null text is one token, the end of its document."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), SEQUENCE)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("source_mix", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs


#: A classifier, an iterated search and a packing plan are not for SQL; tests/llm check the stages against plain Python.
ORACLE_SQL = None
