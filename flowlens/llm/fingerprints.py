"""Document fingerprints: all shingle hashes of a document.

The part of one fingerprint that is in another is how much of one document is in the
other, however short or unequal they are. On request only the hashes below a fixed share
of the range are kept; then a document that has shingles but none below the threshold
keeps its smallest hash, and what short texts have in common may not be seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.linking import lookup
from flowlens.llm.words import let, words
from flowlens.session import materialize

SHINGLE = 5
SCALE = 1  # one hash in so many is kept: all of them
_BITS = (12, 16, 16, 16)  # ids are looked through in groups of 2^12, then 2^16


def sketch(text: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes; a text of fewer words than ``size`` is one shingle."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)))
        every = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, F.lit(size))))
        return F.when(F.size(h) > 0, every).otherwise(F.expr("cast(array() as array<bigint>)"))

    if scale == 1:
        return F.sort_array(F.array_distinct(let(hashed, runs)))
    threshold = -(1 << 63) + (1 << 64) // scale

    def kept(every: Column) -> Column:
        below = F.filter(every, lambda x: x < F.lit(threshold))
        return F.when((F.size(below) > 0) | (F.size(every) == 0), F.sort_array(F.array_distinct(below))).otherwise(
            F.array(F.array_min(every))
        )

    return let(let(hashed, runs), kept)


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller fingerprint that is in the other; 1 for two empty ones, 0 if
    only one is empty."""
    least = F.least(F.size(a), F.size(b))
    return (
        F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0)
        .when(least == 0, 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / least)
    )


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ",")


def _next_lower(ids: DataFrame, bits=_BITS) -> DataFrame:
    """``id, below``: the next lower id of each distinct id; null for the lowest.

    Ids are grouped by their high bits, so no group has more than 2^bits rows at any
    level, whatever the ids are; the lowest of a group goes on with the highest of the
    next lower group, which is found the same way.
    """
    order = Window.orderBy(F.desc("id"))
    if not bits:
        return ids.select("id", F.lead("id").over(order).alias("below"))
    high = F.shiftright("id", bits[0])
    inside = Window.partitionBy("high").orderBy(F.desc("id"))
    rows = ids.withColumn("high", high).withColumn("below", F.lead("id").over(inside))
    tops = ids.groupBy(high.alias("high")).agg(F.max("id").alias("top"))
    after = _next_lower(tops.select(F.col("high").alias("id")), bits[1:])
    step = after.join(
        tops.select(F.col("high").alias("below"), F.col("top").alias("_top")), "below"
    ).select(F.col("id").alias("high"), "_top")
    return rows.join(step, "high", "left").select(
        "id", F.coalesce("below", "_top").alias("below")
    )


def with_edits(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, scale: int = SCALE
) -> DataFrame:
    """Fingerprints of every text and of an edited one, and their likeness.

    The edited text has its last third replaced by the first characters of the next
    document in descending order of ids, rows of one id in the order of their texts;
    after the last comes the first. Rows without an id have no next document: nothing
    replaces their last third and ``near_next`` is 0 (1 if the text has no words). Null
    texts count as empty. All rows stay; the result has its own columns only.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    block = F.shiftright(F.col("doc_id").cast("bigint"), _BITS[0])
    inside = Window.partitionBy("block").orderBy(F.desc("doc_id"), "text")
    numbered = plain.where(F.col("doc_id").isNotNull()).withColumn("block", block)
    # Only texts move: a fingerprint is larger than its text, so it is made where it is used.
    rows = numbered.withColumn("next", F.lead("text").over(inside))

    # The last row of a block goes on with the first row of the next block.
    tops = (
        docs.where(F.col(doc_id).isNotNull())
        .groupBy(F.shiftright(F.col(doc_id).cast("bigint"), _BITS[0]).alias("block"))
        .agg(F.max(doc_id).alias("doc_id"))
    )
    tops = materialize(tops, "tops")
    below = _next_lower(tops.select(F.col("block").alias("id")), _BITS[1:])
    highest = tops.agg(F.max("block").alias("highest"))
    below = below.join(F.broadcast(highest)).select(
        F.col("id").alias("block"), F.coalesce("below", "highest").alias("below")
    )
    firsts = (
        plain.join(lookup(tops.select("doc_id", "block")), "doc_id")
        .groupBy("block")
        .agg(F.min("text").alias("first"))
    )
    heads = below.join(firsts.withColumnRenamed("block", "below"), "below").select("block", "first")
    linked = rows.join(heads, "block", "left").select("doc_id", "text", F.coalesce("next", "first").alias("next"))
    lone = plain.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("string").alias("next"))
    chars = F.char_length("text")
    cut = F.floor(chars / 3).cast("int")
    edited = F.concat(
        F.substr(F.col("text"), F.lit(1), chars - cut),
        F.coalesce(F.substr(F.col("next"), F.lit(1), cut), F.lit("")),
    )
    return (
        linked.unionByName(lone)
        .withColumn("edited", edited)
        .withColumn("sketch", sketch(F.col("text"), size, scale))
        .withColumn("edited_sketch", sketch(F.col("edited"), size, scale))
        .withColumn("next_sketch", sketch(F.col("next"), size, scale))
        .select(
            "doc_id",
            F.char_length("text").cast("bigint").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("sketch")).alias("fingerprint"),
            as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
            likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        )
    )
