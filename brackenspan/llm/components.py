"""Connected components of a table of links, by contraction: least neighbours make trees, trees become nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenspan.llm.common import released, stored


def _renamed(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the nodes of ``column`` replaced by their labels, where they have one."""
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_label", column)).drop("_label")


def _edges(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The distinct links between the components so far, smaller node first."""
    if labels is not None:
        links = _renamed(_renamed(links, "a", labels), "b", labels)
    return stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _trees(edges: DataFrame) -> DataFrame:
    """node, label (its tree's root) where each node hangs on its least smaller neighbour; roots have no row.

    Each pass looks up the label's own label, so a path halves.
    """
    trees = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "trees")
    while True:
        above = trees.select(F.col("node").alias("label"), F.col("label").alias("_above"))
        last, trees = trees, stored(trees.select("node", "label").join(above, "label", "left").select("node", F.coalesce("_above", "label").alias("label"), F.col("_above").isNotNull().alias("moved")), "trees")
        released(last)
        if not trees.where("moved").head(1):
            return trees.select("node", "label")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label (the component's least node) of every node but the least ones.

    The nodes are those of ``links`` (a, b) and of ``known``, the components that other links make; only links
    between known components cost work. Links may repeat, run either way or from a node to itself; nulls link
    nothing. No links, no rows. A root that is not its component's least node either took in all its neighbours or
    has a smaller one in the next round, so rounds grow with the logarithm of the nodes.
    """
    edges, labels = _edges(links, known), known
    while edges.head(1):
        trees = _trees(edges)
        labels = trees if labels is None else stored(_renamed(labels, "label", trees).select("node", "label").union(trees), "labels")
        last, edges = edges, _edges(edges, trees)
        released(last)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")) if labels is None else labels
