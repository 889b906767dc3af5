"""Connected groups of similar things from shared buckets, without all pairs.

A bucket names things that may be similar. Groups need no more than enough confirmed
links to hold together, so most pairs of a large bucket need no look: each thing is
first compared with one hub of the bucket, and only things that are then still in
different groups are compared with each other. Links between things of one group are
not lost, they would change nothing. Buckets that are still large then share something
that makes no link; finer ones take their place, by what is rare in them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

BROADCAST_ROWS = 500_000  # of two or three numbers each
LARGE = 16  # members of a bucket that are compared pair by pair without finer buckets


def lookup(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have few rows."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for all ids in the links ``a, b``: the smallest id reachable.

    Alternates two steps until nothing changes: every id's larger neighbours go to its
    smallest neighbour, then its smaller ones do. No step makes more rows than it reads.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()
        edges = materialize(small, "small")
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


@dataclass(frozen=True)
class SetFilter:
    """A bound on what two sets share, to leave out pairs that cannot be links.

    ``rows`` has ``id, size`` and columns of whole numbers whose bits stand for the set:
    each element sets one. Where the bits of two sets differ, their elements do, so the
    sets differ in at least as many elements. A link needs 100 * intersection of at least
    ``percent`` * union.
    """

    rows: DataFrame
    percent: int

    def names(self) -> list[str]:
        return [c for c in self.rows.columns if c != "id"]

    def allows(self, suffix: str) -> Column:
        """Whether a row and the one whose columns have the suffix can be linked."""
        bits = [c for c in self.names() if c != "size"]
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + suffix))) for c in bits), F.lit(0))
        # Sizes add up to twice what is shared and what is apart.
        total = F.col("size") + F.col("size" + suffix)
        return (100 - self.percent) * total >= (100 + self.percent) * apart


def link_groups(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    only: SetFilter | None = None,
    hub_rounds: int = 2,
    finer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id, component`` of all ids that are linked with another.

    ``members`` has ``bucket, id, lead``: a bucket's candidates are its pairs of different
    ids of which at least one leads. ``confirm`` gets distinct pairs ``a, b`` with a < b
    and returns those that are links.

    Each round takes one leading id of a bucket as its hub, another one every time, and
    compares the ids with it that are not in its group yet. What is left after some
    rounds is compared pair by pair, but only across groups and never twice, so that
    every candidate pair is a link, no link, or within a group.

    Later hubs differ from bucket to bucket, so that a thing meets many others in one
    round. From then on only the pairs are compared that ``only`` allows.

    Buckets that are left with more than ``LARGE`` members share something common that
    makes no links. ``finer`` gets their ``id`` and returns ``bucket, id, lead, far`` with
    buckets of its own, in which all links among these ids are candidates again. They
    take the place of the large ones; hubs are those of least ``far``.
    """
    lead = F.when(F.col("lead"), F.col("id"))
    hubs = (
        members.groupBy("bucket")
        .agg(F.min(lead).alias("hub"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where("hub is not null and low <> high")
        .select("bucket", "hub")
    )
    hubs = materialize(hubs, "hubs")
    shared = materialize(
        members.join(lookup(hubs), "bucket").select("bucket", "id", "lead", "hub").distinct(), "shared"
    )
    found = _Found(confirm, only)
    found.compare(shared.where("id <> hub").select(F.col("hub").alias("id_2"), "id"))
    shared = shared.select("bucket", "id", "lead", F.lit(0).alias("far"))
    for turn in range(1, hub_rounds):
        shared = found.unsettled(shared)
        found.compare(found.with_hubs(shared, turn))
    shared = found.unsettled(shared)
    if finer:
        large = materialize(shared.groupBy("bucket").count().where(F.col("count") > LARGE).select("bucket"), "large")
        few = large.count()
        if few:
            ids = shared.join(lookup(large, few), "bucket").select("id").distinct()
            fine = materialize(finer(materialize(ids, "ids")), "finer")
            fine = found.unsettled(fine)
            found.compare(found.with_hubs(fine, hub_rounds))
            small = shared.join(lookup(large, few), "bucket", "left_anti")
            shared = found.unsettled(small.unionByName(fine))
    found.compare(found.all_pairs(shared))
    return components(hubs.selectExpr("hub as a", "hub as b").limit(0)) if found.groups is None else found.groups


class _Found:
    """Pairs that were compared, the links among them, and the groups these make."""

    def __init__(self, confirm: Callable[[DataFrame], DataFrame], only: SetFilter | None):
        self.confirm, self.only = confirm, only
        self.tested = self.links = self.groups = None

    def compare(self, pairs: DataFrame) -> None:
        """Confirm the pairs ``id, id_2`` that were not compared before."""
        pairs = pairs.select(F.least("id_2", "id").alias("a"), F.greatest("id_2", "id").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.take(1):
            return
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        new = materialize(self.confirm(pairs), "confirmed")
        if not new.take(1):
            return
        self.links = new if self.links is None else self.links.unionByName(new)
        self.groups = components(self.links)

    def unsettled(self, shared: DataFrame) -> DataFrame:
        """Members, with their groups, of the buckets that have members of several groups."""
        shared = shared.select("bucket", "id", "lead", "far")
        if self.groups is None:
            named = shared.withColumn("component", F.col("id"))
        else:
            named = shared.join(self.groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = (
            named.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low <> high")
            .select("bucket")
        )
        named = named.join(several, "bucket")
        if self.only:
            named = named.join(self.only.rows, "id")
        return materialize(named, "open")

    def with_hubs(self, shared: DataFrame, turn: int) -> DataFrame:
        """Pairs of ids of different groups with the hub of their bucket."""
        order = F.struct(F.col("far").alias("_far"), F.xxhash64("id", "bucket", F.lit(turn)), *shared.columns)
        hub = shared.where("lead").groupBy("bucket").agg(F.min(order).alias("hub"))
        hub = hub.select(*[F.col(f"hub.{c}").alias(c if c == "bucket" else f"{c}_2") for c in shared.columns])
        return self._joined(shared, hub, F.expr("component <> component_2"))

    def all_pairs(self, shared: DataFrame) -> DataFrame:
        """Pairs of ids of different groups that share a bucket in which one of them leads."""
        other = shared.select(*[F.col(c).alias(c if c == "bucket" else f"{c}_2") for c in shared.columns])
        fits = F.expr("component <> component_2 and (component < component_2 or not lead_2)")
        return self._joined(shared.where("lead"), other, fits)

    def _joined(self, shared: DataFrame, other: DataFrame, fits: Column) -> DataFrame:
        if self.only:
            fits &= self.only.allows("_2")
        return shared.join(other, "bucket").where(fits).select("id_2", "id")
