"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); a component is named by its smallest node.

    Each round every node hands the smallest neighbour it knows to its other neighbours (the large-star and small-star
    steps), so a component of n nodes takes about log n rounds. Rows move by node with map-side minima first; a round
    is written to the shared folder, which cuts lineage.
    """

    def starred(edges: DataFrame, larger_only: bool) -> DataFrame:
        # from each node u: its smallest neighbour m (or u itself); then m is linked with the chosen neighbours
        smallest = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        rows = edges.join(smallest, "u").filter(F.col("v") > F.col("u") if larger_only else F.col("v") <= F.col("u"))
        own = [] if larger_only else [smallest.select(F.col("u").alias("v"), "m")]
        found = rows.select("v", "m")
        for more in own:
            found = found.unionByName(more)
        return found.filter(F.col("v") != F.col("m")).distinct()

    edges = staged(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(), "links"
    )
    before = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            edges.select(F.col("m").alias("u"), "v")
        )
        large = starred(both, True)
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(starred(down, False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    roots = edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)
