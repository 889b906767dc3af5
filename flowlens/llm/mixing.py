"""Mixing sources to target weights by weighted fair queueing.

Each source gives its documents in a shuffled order, up to ``most`` times over. An
entry's virtual finish time is its source's running number of words divided by the
source's target, so at any time all sources have given the same share of their
targets. The entries with the earliest finish times, up to the total budget, are the
mix; the entry that crosses the budget is cut.

Running sums need no task that sees a whole source or the whole mix: they are taken
over ranges of the order, first the sums of ranges, then the rows inside each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.words import unused, words
from flowlens.session import materialize

WEIGHTS = (3, 1, 2)
RANGE_ROWS = 20_000  # rows that a range is meant to have


def shuffle_key(doc_id: Column) -> Column:
    """The place of a document in its source's shuffled order."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def target_weights(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share
    ``share`` times all words. No target is above ``most`` times its source's size; what
    is over goes to the others by weight. With sources in order of size by weight, the
    words per unit of weight are the largest of what remains when the first few are
    full, so no loop is needed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("place", place).withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    )
    full = F.col("source_size") * most
    order = Window.orderBy(full / F.col("weight"), "place")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    rows = rows.withColumn("level", (budget - before) / rest)
    level = F.max("level").over(every)
    return rows.select(
        "source",
        "source_size",
        F.least(full.cast("double"), level * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights=WEIGHTS, share: float = 1.5, most: int = 2,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``size`` is the number of words; null and empty texts have none and give nothing.
    A null source is a source, a null id an id. Rows with equal id, source and size are
    one entry and share what it gives equally, rounded down. An empty table gives an
    empty result.
    """
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.size(words(F.col(text))).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    return _mixed(sized, weights, share, most)


def _mixed(sized: DataFrame, weights, share: float, most: int) -> DataFrame:
    entries = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    totals = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    targets = target_weights(totals, weights, share, most)
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / RANGE_ROWS + 1, 16)))

    entries = (
        entries.where("size > 0")
        .withColumn("words", F.col("size") * F.col("copies"))
        .withColumn("key", shuffle_key(F.col("doc_id")))
        .withColumn("range", F.substring("key", 1, digits))
    )
    # The running number of words in the source: ranges of the shuffled order first.
    to_here = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        entries.groupBy("source", "range")
        .agg(F.sum("words").alias("_words"))
        .select(
            F.col("source").alias("_source"),
            F.col("range").alias("_range"),
            F.coalesce(F.sum("_words").over(to_here), F.lit(0)).alias("before"),
        )
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    ran = (
        entries.withColumn("run", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
        .withColumn("run", F.col("run") + F.col("before"))
        .drop("_source", "_range", "before")
    )
    named = targets.withColumnRenamed("source", "_source")
    passes = (
        ran.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn(
            "finish",
            (F.col("run") + F.col("pass") * F.col("source_size")).cast("double") / F.col("target"),
        )
    )
    # Ranges of finish times are equal ratios, so that late ones cannot be too many.
    steps = max(16, rows // RANGE_ROWS)
    passes = materialize(
        passes.select(
            "doc_id", "source", "size", "copies", "words", "key", "pass", "finish",
            F.floor(F.log2("finish") * steps).alias("range"),
        ),
        "passes",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = passes.groupBy("range").agg(F.sum("words").alias("_words")).select(
        F.col("range").alias("_range"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("before"),
    )
    budget = F.broadcast(
        totals.agg(F.floor(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    )
    inside = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "pass")
    left = F.col("budget") - F.col("before") - F.coalesce(
        F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    taken = (
        passes.join(offsets, F.col("range") == F.col("_range"))
        .join(budget)
        .select(
            "doc_id", "source", "size", "copies",
            F.least(F.col("words"), F.greatest(left, F.lit(0))).alias("given"),
        )
        .groupBy("doc_id", "source", "size")
        .agg(F.floor(F.sum("given") / F.first("copies")).alias("_taken"))
        .select(
            F.col("doc_id").alias("_id"), F.col("source").alias("_src"),
            F.col("size").alias("_size"), "_taken",
        )
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_src"))
        & (F.col("size") == F.col("_size"))
    )
    return (
        sized.join(taken, same, "left")
        .join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            "doc_id", "source", "size", F.col("source_size"), "target",
            F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )


def mix_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is
    taken whole, and one with its first words for what is left over.

    Documents of which nothing is taken go. A document without words goes too.
    """
    of, src, size, taken, n, take = unused(docs.columns, "of", "src", "size", "taken", "n", "take")
    plan = mix(docs, text, doc_id, source, **options).where("taken > 0").select(
        F.col("doc_id").alias(of), F.col("source").alias(src), F.col("size").alias(size),
        F.col("taken").alias(taken),
    ).distinct()
    rows = docs.withColumn(n, F.size(words(F.col(text))).cast("bigint"))
    same = (
        F.col(doc_id).eqNullSafe(F.col(of))
        & F.col(source).eqNullSafe(F.col(src))
        & (F.col(n) == F.col(size))
    )
    rest = F.col(taken) % F.col(n)
    times = F.concat(
        F.array_repeat(F.col(n), F.floor(F.col(taken) / F.col(n)).cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    whole = F.col(take) == F.col(n)
    # The first words: skip blanks, then as many words with the blanks between them.
    cut = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.col(take).cast("int")), " ")
    return (
        rows.join(plan, same)
        .withColumn(take, F.explode(times))
        .withColumn(text, F.when(whole, F.col(text)).otherwise(cut))
        .select(*docs.columns)
    )
