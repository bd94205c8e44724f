"""Components of items that share groups, where a test on the items decides which pairs are linked.

Shared by the operators that find candidates as members of common groups (buckets, segments).  In
each group the smallest item leads and is tested against every member; verified pairs are grouped
into components.  Where a group then still holds several components, the leader of each component
in the group is tested against the other components' members, and at last whatever pairs of
different components are left.  So a group of copies costs as many tests as it has members, and no
pair of a common group that could join two components goes untested.

Before a pair is formed, ``near`` bounds by the traits of its items whether they can be linked at all;
it stands in the join's condition, so that pairs which it rules out are never rows.

Aggregates are written before they are joined back, so that a join has exchanges of its own on both
sides and Spark can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.components import connected_components
from inkwell.session import checkpointed, discard


def link_groups(
    members: DataFrame, traits: DataFrame, test: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column]
) -> DataFrame:
    """node and component of the items of members (group, id) that ``test`` links.

    ``test`` takes distinct pairs a, b, where a may be in many of them, and returns those that are linked.  traits (id, traits) has a row
    for each item; ``near`` says by the traits of two items whether they may be linked.
    """
    traits = traits.select(F.col("id").alias("of"), "traits")
    lead = members.groupBy("group").agg(F.min("id").alias("a"), F.count("*").alias("many")).where("many > 1")
    lead = checkpointed(lead.select("group", "a"))
    shared = checkpointed(members.join(lead, "group").select("group", "id", "a"))
    pairs = shared.where("id != a").select("a", F.col("id").alias("b")).distinct()
    left = traits.select(F.col("of").alias("of_a"), F.col("traits").alias("traits_a"))
    pairs = pairs.join(left, F.col("a") == F.col("of_a")).join(traits, F.col("b") == F.col("of"))
    tested = checkpointed(pairs.where(near(F.col("traits_a"), F.col("traits"))).select("a", "b"))
    links = checkpointed(test(tested))
    found = connected_components(links)
    for leaders_only in (True, False):
        apart = _apart(shared, found, traits)
        if apart.isEmpty():
            break
        pairs = _pairs(apart, leaders_only, near).join(tested, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        discard(apart)
        if pairs.isEmpty():
            continue
        other = F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        links = checkpointed(links.union(test(pairs.select(F.col("lead").alias("a"), other.alias("b")))))
        tested = checkpointed(tested.union(pairs.select("a", "b")))
        found = connected_components(links)
    discard(lead, shared)
    return found


def _apart(shared: DataFrame, found: DataFrame, traits: DataFrame) -> DataFrame:
    """group, id, traits, part of the members of groups that hold several components (part)."""
    placed = shared.join(found, F.col("id") == F.col("node"), "left")
    placed = checkpointed(placed.select("group", "id", F.coalesce("component", "id").alias("part")))
    split = placed.groupBy("group").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most")
    split = checkpointed(split.select("group"))
    kept = placed.join(split, "group", "left_semi").join(traits, F.col("id") == F.col("of"))
    kept = checkpointed(kept.select("group", "id", "traits", "part"))
    discard(placed, split)
    return kept


def _pairs(apart: DataFrame, leaders_only: bool, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Distinct pairs a < b of different components in one group, and which of both leads the test.

    With ``leaders_only`` of each component only its leader meets the others; it leads, as it has many pairs.
    """
    left = apart
    if leaders_only:
        left = checkpointed(apart.groupBy("group", "part").agg(F.min_by(F.struct("id", "traits"), "id").alias("l")))
        left = left.select("group", "part", "l.id", "l.traits")
    left = left.select("group", F.col("part").alias("part_a"), F.col("id").alias("x"), F.col("traits").alias("traits_a"))
    fits = (F.col("part") != F.col("part_a")) & near(F.col("traits_a"), F.col("traits"))
    if not leaders_only:
        fits = fits & (F.col("x") < F.col("id"))
    met = left.join(apart, "group").where(fits)
    pairs = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"), F.col("x").alias("lead"))
    return pairs.groupBy("a", "b").agg(F.min("lead").alias("lead"))
