"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_column, global_rank, staged, word_count

CYCLE = (5, 2, 1)


def water_fill(sources: DataFrame, total: float, max_epochs: float, rounds: int = 200) -> DataFrame:
    """sources (weight double, source_size long) with target double: total shared by weight, no target above max_epochs sizes.

    In each round the sources above their cap are clamped to it and what they leave is shared among the others by weight,
    until none is above. A round is one aggregate over the sources; the driver sees two sums and a count.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, F.lit(False)
    for _ in range(rounds):
        # Share per unit of weight with the sources clamped so far; a clamped source stays so, for the level only rises.
        row = sources.agg(
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(clamped, cap).otherwise(0.0)).alias("capped"),
            F.sum(clamped.cast("long")).alias("n"),
        ).first()
        if not row["weight"]:
            level = float("inf")
            break
        now = max(0.0, total - row["capped"]) / row["weight"]
        if level is not None and row["n"] == n_clamped:
            break
        level, n_clamped = now, row["n"]
        clamped = F.col("weight") * F.lit(level) >= cap
    else:
        raise RuntimeError(f"targets have not settled in {rounds} rounds")
    return sources.withColumn("target", F.when(clamped | F.lit(level == float("inf")), cap).otherwise(F.col("weight") * F.lit(level)))


#: What mix() adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_epochs", "mix_extra", "mix_taken")


def mix_columns(docs: DataFrame) -> dict[str, str]:
    """What mix() calls the columns it adds: with underscores in front where docs has such a column."""
    return {n: free_column(docs, n) for n in ADDED}


def mix(docs: DataFrame, share: float = 1.0, max_epochs: int = 3, seed: int = 11, buckets: int = 1024, cycle: tuple[int, ...] = CYCLE, size: Column | None = None) -> DataFrame:
    """How often each document enters a mix of its sources.

    Sources in code-point order, null last, weigh the numbers of cycle in turn. The mix holds share of all words; a source
    gives at most max_epochs times its own. Adds to docs: mix_size (words), mix_source_size and mix_target (its source's),
    mix_epochs (whole repetitions that all documents of the source get), mix_extra (words of one further repetition) and
    mix_taken (all words it gives). The further repetition goes to documents in an order that seed fixes until the
    source's target is met: mix_extra is the whole size for those before that point, the rest of the target for the one
    that crosses it and 0 beyond.

    Running totals never gather a source in a task: documents are dealt by hash into buckets in each source, totals of
    buckets are summed up first, and a task then sums within one bucket of one source. A null text has no words, a null
    doc_id is an id like others, a null source is a source. Equal rows are interchangeable. All columns of docs stay; an added
    name that docs has already gets underscores in front (mix_columns). An empty table gives an empty result.
    """
    words = word_count(F.col("text")) if size is None else size
    added = mix_columns(docs)
    own = {n: free_column(docs, f"_mix_{n}") for n in ("size", "hash", "bucket", "before", "source", "b", "start", "total", "target", "whole", "rest")}
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.withColumns({own["size"]: words, own["hash"]: order}).withColumn(own["bucket"], F.pmod(F.col(own["hash"]), F.lit(buckets)).cast("int"))
    cells = staged(sized.groupBy(F.col("source").alias("source"), F.col(own["bucket"]).alias("b")).agg(F.sum(own["size"]).alias("cell")))
    totals = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()])
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    sources = staged(ranked.withColumn("weight", F.get(weights, F.pmod(F.col("rank"), F.lit(len(cycle))).cast("int"))))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    filled = water_fill(sources, total, max_epochs)
    # Whole repetitions, and the words still missing from the target.
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", epochs)
    filled = filled.withColumn("rest", F.when(F.col("whole") >= max_epochs, F.lit(0)).otherwise(F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("cell").over(before), F.lit(0)))
    filled = filled.select(F.col("source").alias("of"), F.col("source_size").alias("total"), "target", "whole", "rest")
    plan = starts.join(filled, F.col("source").eqNullSafe(F.col("of")))
    plan = staged(plan.select(*[F.col(c).alias(own[c]) for c in ("source", "b", "start", "total", "target", "whole", "rest")]))
    within = Window.partitionBy("source", own["bucket"]).orderBy(own["hash"], "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn(own["before"], F.coalesce(F.sum(own["size"]).over(within), F.lit(0)))
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col(own["source"])) & (F.col(own["bucket"]) == F.col(own["b"])))
    left = F.col(own["rest"]) - F.col(own["start"]) - F.col(own["before"])
    extra = F.greatest(F.lit(0), F.least(F.col(own["size"]), left)).cast("long")
    values = (F.col(own["size"]), F.col(own["total"]).cast("long"), F.col(own["target"]), F.col(own["whole"]), extra, F.col(own["whole"]) * F.col(own["size"]) + extra)
    return joined.select(*docs.columns, *[v.alias(added[n]) for n, v in zip(ADDED, values, strict=True)])


def repeated(mixed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The mix itself: each document as often as mix_epochs says, then its first mix_extra words once more; n_chars follows the text.

    columns: those of the documents (else all of mixed but the last six, which mix() has added). A null or wordless text comes as often as
    mix_epochs says. Repeated rows come each for itself, and an empty table gives an empty result.
    """
    own = mixed.columns[: -len(ADDED)] if columns is None else columns
    size, _, _, epochs, extra, taken = (F.col(c) for c in mixed.columns[-len(ADDED) :])
    copy, cut_at = free_column(mixed, "_copy"), free_column(mixed, "_partial")
    copies = F.sequence(F.lit(1).cast("long"), epochs + F.when(extra > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    rows = mixed.where((taken > 0) | (epochs > 0)).withColumn(copy, F.explode(copies))
    rows = rows.withColumn(cut_at, (F.col(copy) > epochs) & (extra < size))
    # A part is a word with the white space before it.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), extra).cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col(cut_at), cut).otherwise(F.col("text")))
    if "n_chars" in own:
        rows = rows.withColumn("n_chars", F.when(F.col(cut_at), F.char_length("text").cast(mixed.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*own)


def op10_source_mix(spark, sf_dir):
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_epochs").alias("epochs"))
