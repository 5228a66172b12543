"""Connected components over an edge table, as Spark joins and minimum aggregates (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions, and of each node ``a`` the least of it and its neighbours and whether it is part of a star.

    A centre has greater neighbours only, a leaf has one neighbour and that is less; if all nodes are so, the edges are
    stars.  The least is pre-aggregated before its shuffle and written, so the join that hands it back reads two plain
    shuffles, which AQE splits where a node has very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return both, stored(near.select("a", F.least("a", "low").alias("m"), ((F.col("low") > F.col("a")) | (F.col("low") == F.col("high"))).alias("star")), "least")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours linked to the least of them, as a table in the shared folder."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    out = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    drop_stored(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: one orderable type, structs too) -> (node, root): every node that has an edge, with the least node it can reach.

    Self-loops, repeated and reversed edges are harmless; no edges give no rows.  In a round the large star links each
    node's greater neighbours to the least of its neighbourhood, then the small star its lesser ones; rounds end when
    the edges form stars, so edges that are stars already take none.  Each half is a table in the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both, least = _neighbours(now)
        if least.agg(F.min("star")).first()[0] is not False:
            drop_stored(least)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        large = stored(both.where("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        drop_stored(now, least)
        now = _small_star(large)
        drop_stored(large)


def grouped(members: DataFrame, node: str, links: DataFrame, doc_id: str = "first_id") -> DataFrame:
    """``members`` (``node``, ``doc_id``: its smallest document) -> (``node``, component_id: the smallest document of the node's component), stored.

    Nodes are ordered by their document, so that a component's root already is the answer and no row has to meet at
    it.  A node without a document is ordered last; a component of only such nodes has a null component_id.
    """
    label = F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(node).alias("key"))
    named = members.select(F.col(node).alias("key"), label.alias("label"))
    edges = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(edges).select(F.col("node.key").alias(node), F.when(~F.col("root.none"), F.col("root.id")).alias("least"), F.lit(True).alias("linked"))
    return stored(members.join(roots, node, "left").select(node, F.when(F.col("linked"), F.col("least")).otherwise(F.col(doc_id)).alias("component_id")), "grouped")
