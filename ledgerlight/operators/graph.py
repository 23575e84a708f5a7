"""Connected components and the identity graph of merged donors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_label
from ..store import cut
from .dedup import first_by


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _with_group(edges: DataFrame, groups: DataFrame, node: str) -> DataFrame:
    """Edges joined with the one row of their node. The key is a hash of the node, so that both sides are dealt anew by it: a side that is still
    dealt by its own aggregate is one that Spark can't split, and a hub's edges would be one task's.
    """
    key = F.xxhash64(F.lit(node), node).alias("_dealt")
    of = groups.select(key, F.col(node).alias("_node"), *[c for c in groups.columns if c != node])
    return edges.withColumn("_dealt", key).join(of, "_dealt").filter(F.col(node) == F.col("_node")).drop("_dealt", "_node")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node on an edge (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; rounds grow with the logarithm of the graph's size, not its diameter.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(ordered, "edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_group(both.filter("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = _with_group(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = cut(star.filter("a > b").distinct(), "edges")
        edges, before, state = after, state, _state(after)
        if state == before:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def merge_edges(overrides: DataFrame, aliases: DataFrame, donors: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Edges between donors whose aliases a reviewer merged; vanished ids follow their anchored alias to its donor of today."""
    named = aliases.select("alias_key", "donor_id")
    merged = overrides.filter("decision = 'merge'")
    edges = merged.join(named.select(F.col("alias_key").alias("alias_a"), F.col("donor_id").alias("a")), "alias_a").join(named.select(F.col("alias_key").alias("alias_b"), F.col("donor_id").alias("b")), "alias_b").select("a", "b")
    if anchors is not None:
        gone = anchors.join(donors.select("donor_id"), "donor_id", "left_anti")
        edges = edges.unionByName(gone.select(F.col("donor_id").alias("a"), "alias_key").join(named, "alias_key").select("a", F.col("donor_id").alias("b")))
    return edges


def identity_map(donors: DataFrame, aliases: DataFrame, overrides: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(donor_id, entity_id) of every donor: a group's entity is its most recently decided kept alias's donor, else its smallest donor that exists."""
    groups = cut(components(merge_edges(overrides, aliases, donors, anchors)), "groups")
    kept = overrides.filter("decision = 'merge' and keep_alias_key is not null").join(aliases.select(F.col("alias_key").alias("keep_alias_key"), F.col("donor_id").alias("node")), "keep_alias_key")
    kept = kept.join(groups, "node").join(donors.select(F.col("donor_id").alias("node")), "node", "left_semi")
    chosen = first_by(kept, ["root"], [F.desc_nulls_last("decided_at"), F.asc("node")]).select("root", F.col("node").alias("kept"))
    alive = groups.join(donors.select(F.col("donor_id").alias("node")), "node", "left_semi").groupBy("root").agg(F.min("node").alias("least"))
    entities = groups.join(chosen, "root", "left").join(alive, "root", "left").select(F.col("node").alias("donor_id"), F.coalesce("kept", "least").alias("entity_id"))
    everyone = donors.select("donor_id").unionByName(entities.select("donor_id")).distinct()
    return everyone.join(entities, "donor_id", "left").select("donor_id", F.coalesce("entity_id", "donor_id").alias("entity_id"))


def conflicts(overrides: DataFrame, aliases: DataFrame, identity: DataFrame) -> DataFrame:
    """Pairs decided separate that one entity holds: a graph without rows here is valid."""
    named = aliases.join(identity, "donor_id").select("alias_key", "entity_id")
    pairs = overrides.filter("decision = 'separate'")
    out = pairs.join(named.select(F.col("alias_key").alias("alias_a"), F.col("entity_id").alias("entity_a")), "alias_a").join(named.select(F.col("alias_key").alias("alias_b"), F.col("entity_id").alias("entity_b")), "alias_b")
    return out.filter("entity_a = entity_b")


def members(identity: DataFrame, donor_id: str) -> DataFrame:
    """All donors of a donor's entity; itself if it is unknown."""
    entity = identity.filter(F.col("donor_id") == donor_id).select("entity_id")
    group = identity.join(entity, "entity_id", "left_semi").select("donor_id")
    return group.unionByName(group.sparkSession.createDataFrame([(donor_id,)], group.schema)).distinct()


def unambiguous_labels(names: DataFrame, identity: DataFrame) -> DataFrame:
    """Labels (of names and aliases: donor_id, name) that belong to one entity only."""
    rows = names.join(identity, "donor_id", "left").select(identity_label("name").alias("label"), F.coalesce("entity_id", "donor_id").alias("entity_id"))
    return rows.filter("label <> ''").groupBy("label").agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("n")).filter("n = 1").drop("n")


def touched_filers(txn: DataFrame, donors: DataFrame) -> DataFrame:
    """Committees that any of some donors gave to."""
    return txn.join(donors.select("donor_id"), "donor_id", "left_semi").select("filer_id").distinct()


def adopted_spellings(decisions: DataFrame) -> DataFrame:
    """(name, spelling): each merged name's kept one by the latest decision, followed through chains of any length; a chain that runs into a
    cycle ends at the cycle's smallest name.

    Each round follows twice as far as the one before, so rounds grow with the logarithm of the longest chain.
    """
    first = first_by(decisions.filter("decision = 'merge'"), ["merged_name"], [F.desc_nulls_last("decided_at"), F.asc("pair_key")]).select(F.col("merged_name").alias("name"), F.col("kept_name").alias("spelling"))
    out = cut(first.filter("name <> spelling").withColumn("least", F.col("spelling")), "spellings")
    left, reach = out.count(), 1
    while reach <= 2 * left:  # a chain is no longer than there are names
        step = out.select(F.col("name").alias("spelling"), F.col("spelling").alias("_next"), F.col("least").alias("_least"))
        joined = out.join(step, "spelling", "left")
        moved = joined.filter("_next is not null").limit(1).count()
        out = cut(joined.select("name", F.coalesce("_next", "spelling").alias("spelling"), F.least("least", "_least").alias("least")), "spellings")
        if not moved:
            break
        reach *= 2
    # What still has a next name is on a cycle, or runs into one: by now it has seen all of it.
    on = out.select(F.col("name").alias("spelling"), F.col("least").alias("_cycle"))
    return out.join(on, "spelling", "left").select("name", F.coalesce("_cycle", "spelling").alias("spelling")).unionByName(first.filter("name = spelling"))
