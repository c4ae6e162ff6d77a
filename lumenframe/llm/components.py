"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Each round is two grouped minima and two joins; the edges of a round are written
to the shared folder, so lineage stays short and nothing reaches the driver but
one flag; the files of earlier rounds are deleted. Rounds end when the edges are
stars, which one aggregation tells, so edges that are stars from the start take no
round. Equal edges and loops are allowed; an edge with a null end is dropped; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import discard, materialise


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    """Edges from larger ids to smaller ones, closer to stars around the least ids."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _with_minimum(large)
    return (
        small.where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(small.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, and no smaller end is a larger end elsewhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not seen.agg(F.max(F.col("below") + F.col("above") > 1)).first()[0]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for all ends of ``edges``; a component is named by its least node."""
    state = materialise(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    while not _are_stars(state):
        last, state = state, materialise(_round(state), "edges")
        discard(last)
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def extended_components(found: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components (node, component) after ``edges`` are added to those of ``found``.

    Only edges between different components matter, and they join components, not
    nodes, so the rounds work on a graph that is mostly far smaller than the first.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for end in "ab":
        known = found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        ends = ends.join(known, end, "left")
    between = ends.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    merged = connected_components(between, "a", "b")
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return found.join(renamed, "component", "left").select("node", F.coalesce("joined", "component").alias("component")).unionAll(
        merged.join(found.select("node"), "node", "left_anti").select("node", "component")
    )
