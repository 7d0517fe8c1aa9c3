"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of `links` (a, b); component is its smallest node.

    Each round hangs a node's larger neighbours on its smallest neighbour, then
    its smaller ones, until nothing changes; chains shorten by about half each
    round. Minima are combined before their shuffle and joined back, so a node
    with many links is not gathered in one place. Each round is a written
    table. Repeated links, loops and either direction are allowed; links with a
    null end are ignored.
    """
    edges = materialize(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
        edges = materialize(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()
