"""How filters that run one after another act on each other.

Every filter has a relation of the ids that fail it. What a filter leaves after others
does not depend on their order, so survivors are kept for sets of filters: each filter
in turn doubles the sets and a left-anti join takes out what fails it. Left-semi and
left-anti joins of the failing ids with the survivors give what a filter removes after
a set, and what it would have removed had the set not done so. Orders are then looked
up, set by set. All joins go by a row number that no two rows share, so that no key is
hot, and nothing but counts per part leaves them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowlens.llm.hot import join_groups
from flowlens.llm.words import words
from flowlens.operators.lookup import fits_broadcast
from flowlens.session import discard, materialize, scratch_path

#: Conditions of the text filters, in their order of bits.
LETTERS = "ABCDE"
REPEAT = "E"


@dataclass
class Failing:
    """The relations of failing ids, a folder each, with what is counted about them."""

    path: str
    rows: DataFrame  # filter, id, part, good, toxic

    def of(self, letter: str) -> DataFrame:
        return self.rows.where(F.col("filter") == letter).select("id")


def conditions(text: Column) -> dict[str, Column]:
    """What fails A to D; null texts are empty."""
    text = F.coalesce(text, F.lit(""))
    every = words(text)
    size = F.char_length(text)
    capitals = size - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(every) < 50,
        "B": F.size(F.array_distinct(every)) * 100 < F.size(every) * 65,
        "C": capitals * 100 > size * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def flag_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``id, doc_id, part, digest`` and a boolean for each of A to D, stored.

    ``id`` numbers the rows, so that repeated or null ids of documents stay apart. A
    null source and an empty one are one part, named by the empty string.
    """
    flags = conditions(F.col(text))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("id"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
            F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest"),
            *[condition.alias(letter) for letter, condition in flags.items()],
        ),
        "flags",
    )


def flag_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with E: a row of a smaller document id has the same text.

    Null ids come after all others, and rows of one id do not repeat each other.
    """
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = F.col("least").isNotNull() & F.coalesce(F.col("doc_id") > F.col("least"), F.lit(True))
    return (
        join_groups(rows, texts, "digest", "n", "left")
        .withColumn(REPEAT, later)
        .drop("digest", "least", "n")
    )


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` as 0 or 1: whether any label of the document
    says quality 1, or toxic 1. Rows without a label or an id count as neither."""
    said = labels.groupBy("doc_id").agg(
        *[
            F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n)
            for c, n in (("quality", "good"), ("toxic", "toxic"))
        ]
    )
    found = rows.where("doc_id is not null").join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    none = rows.where("doc_id is null").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    return found.unionByName(none)


def failing(rows: DataFrame, letters: str = LETTERS) -> Failing:
    """Store the ids that fail each filter in a table of its own."""
    spark = rows.sparkSession
    path = scratch_path(spark, "failing")
    fails = F.filter(
        F.array(*[F.when(F.col(c), F.lit(c)) for c in letters]), lambda letter: letter.isNotNull()
    )
    out = rows.select(F.explode(fails).alias("filter"), "id", "part", "good", "toxic")
    out.write.partitionBy("filter").parquet(path)
    kinds = {f.name: f.dataType for f in out.schema.fields}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("id", "part", "good", "toxic", "filter")]
    )
    return Failing(path, spark.read.schema(schema).parquet(path))


def survivors(rows: DataFrame, fails: Failing, letters: str = LETTERS) -> DataFrame:
    """``id, part, done``: the rows that pass all filters whose bits are in ``done``."""
    left = rows.select("id", "part").repartition("id").withColumn("done", F.lit(0))
    for place, letter in enumerate(letters):
        bit = 1 << place
        gone = fails.of(letter).withColumnRenamed("id", "gone")
        left = left.withColumn("done", F.explode(F.array("done", F.col("done") + bit)))
        # Row numbers are unique, so a hash table of failing ids is an even share of them.
        left = left.join(
            gone.hint("shuffle_hash"),
            (F.col("id") == F.col("gone")) & (F.col("done").bitwiseAND(bit) != 0),
            "left_anti",
        )
    return left


def interactions(rows: DataFrame, fails: Failing, letters: str = LETTERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is counted of sets: ``part, done, kept``; ``part, filter, done, removed,
    good_lost, toxic_lost``; ``part, filter, done, redundant``."""
    left = materialize(survivors(rows, fails, letters), "survivors")
    bit = F.element_at(
        F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), F.col("filter")
    )
    sets = F.array(*[F.lit(s) for s in range(1 << len(letters))])
    tried = fails.rows.withColumn("bit", bit).select(
        "id", "part", "filter", "good", "toxic",
        F.explode(F.filter(sets, lambda s: s.bitwiseAND(F.col("bit")) == 0)).alias("done"),
    )
    # Survivors are repeated numbers and take little room in files: Spark sizes them by that
    # and would broadcast millions of rows.
    here = left.select("id", "done").hint("merge")
    kept = left.groupBy("part", "done").agg(F.count("*").alias("kept"))
    removed = tried.join(here, ["id", "done"], "left_semi").groupBy("part", "filter", "done").agg(
        F.count("*").alias("removed"),
        F.sum("good").alias("good_lost"),
        F.sum("toxic").alias("toxic_lost"),
    )
    redundant = tried.join(here, ["id", "done"], "left_anti").groupBy("part", "filter", "done").agg(
        F.count("*").alias("redundant")
    )
    stored = tuple(materialize(x, "counts") for x in (kept, removed, redundant))
    discard(left)
    return stored


def _measured(counts: DataFrame) -> DataFrame:
    return F.broadcast(counts) if fits_broadcast(counts) else counts.hint("merge")


def by_order(rows: DataFrame, counts, letters: str = LETTERS) -> DataFrame:
    """A row for every part, order and step, zeros included."""
    kept, removed, redundant = (_measured(x) for x in counts)
    orders = F.array(*[F.lit("".join(order)) for order in permutations(letters)])
    step = F.col("step")

    def applied(until: Column) -> Column:
        """The set of filters whose place in the order is at most ``until``."""
        place = [F.instr("filter_order", c) for c in letters]
        return sum((F.when(p <= until, 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))

    every = (
        rows.select("part").distinct()
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("filter", F.substring("filter_order", step, 1))
        .withColumn("before", applied(step - 1))
        .withColumn("after", applied(step))
    )
    out = (
        every.join(kept.withColumnRenamed("done", "after"), ["part", "after"], "left")
        .join(removed.withColumnRenamed("done", "before"), ["part", "filter", "before"], "left")
        .join(redundant.withColumnRenamed("done", "before"), ["part", "filter", "before"], "left")
        .fillna(0, ["kept", "removed", "redundant", "good_lost", "toxic_lost"])
    )
    all_orders = Window.partitionBy("part", "filter")
    return out.select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant",
        # After all others, what a filter removes fails nothing else; every step that is last says so.
        F.max(F.when(F.col("step") == len(letters), F.col("removed"))).over(all_orders).alias("unique_fails"),
        "good_lost", "toxic_lost",
        F.sum("removed").over(all_orders).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """Counts of what five text filters keep and remove in every order, by source.

    ``labels`` has ``doc_id, quality, toxic``; several labels of a document count as one.
    Null texts are empty, null sources an empty part; repeated rows count each, and rows of
    one id do not repeat each other. Other columns are not looked at. An empty table has
    no parts and gives an empty result.
    """
    rows = flag_rows(docs, text, doc_id, source)
    fails = failing(with_labels(flag_repeats(rows), labels.select("doc_id", "quality", "toxic")))
    return by_order(rows, interactions(rows, fails))
