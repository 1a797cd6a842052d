"""Connected components and roots of a forest, over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.session import cut_lineage

_LABELS = "node string, component string"


def _small_components(edges: DataFrame) -> DataFrame:
    """Components of an edge table that was counted and fits one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def find(node: str) -> str:
            parent.setdefault(node, node)
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
        nodes = list(parent)
        if nodes:
            yield pa.RecordBatch.from_pydict({"node": nodes, "component": [find(n) for n in nodes]})

    return edges.coalesce(1).mapInArrow(run, _LABELS)


def connected_components(edges: DataFrame, one_task_edges: int = 200_000) -> DataFrame:
    """Component of every node of the edges (a, b): (node, component).

    A component is named by its lowest node.  Beyond ``one_task_edges`` each
    round gives a node the lowest name among its neighbours and then the name
    of that name, which halves the distance to the lowest node.
    """
    links = cut_lineage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    alone = edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    if links.limit(one_task_edges + 1).count() <= one_task_edges:
        named = _small_components(links)
    else:
        named = _propagate(links)
    lone = alone.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(lone)


def _propagate(links: DataFrame) -> DataFrame:
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    named = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        heard = both.join(named, both.b == named.node).groupBy("a").agg(F.min("component").alias("low"))
        heard = named.join(heard, named.node == heard.a).select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("next"))
        above = named.select(F.col("node").alias("up"), F.col("component").alias("up_component"))
        stepped = cut_lineage(heard.join(above, heard.next == above.up).select(
            "node", "old", F.least("next", "up_component").alias("component")))
        named = stepped.select("node", "component")
        if stepped.filter(F.col("old") != F.col("component")).isEmpty():
            return named


def forest_roots(parents: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Root above every node of the forest (node, parent): (node, root).

    Each round joins the table with itself and doubles the climb.  When
    ``max_nodes`` bounds the table, the number of rounds is known and nothing
    is checked in between.
    """
    current = cut_lineage(parents.select("node", F.col("parent").alias("root")))

    def climb(table: DataFrame) -> DataFrame:
        above = table.select(F.col("node").alias("at"), F.col("root").alias("above"))
        return table.join(above, table.root == F.col("at"), "left").select(
            "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))

    if max_nodes is not None:
        for _ in range(max(1, (max_nodes - 1).bit_length())):
            current = climb(current).drop("moved")
        return current
    while True:
        stepped = cut_lineage(climb(current))
        current = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return current
