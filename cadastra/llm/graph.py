"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import Workspace


def connected_components(edges: DataFrame, workspace: Workspace, name: str = "components") -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node in ``edges`` (``src``, ``dst``, long).

    Each round maps a node to its smallest neighbour's smallest neighbour and contracts the graph: the number of rounds
    grows with the logarithm of the longest path. Minima are combined before the shuffle, so that a node with very many
    links is no hot key of an aggregation; the joins on such a node have one row for it on one side, and AQE splits the
    other. Each round's tables are saved: no lineage builds up, and the driver holds nothing but their names.
    Loops and repeated links do no harm; an empty table gives an empty result.
    """
    tidy = lambda df: df.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = workspace.save(tidy(edges), f"{name}-links0")
    labels: DataFrame | None = None
    number = 0
    while not links.isEmpty():
        both = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(links.select("dst", "src"))
        least = workspace.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("r")), f"{name}-least{number}")
        jump = workspace.save(least.select(F.col("u").alias("node"), F.col("r").alias("u")).join(least, "u").select("node", F.col("r").alias("next")), f"{name}-jump{number}")
        if labels is None:
            labels = jump.select("node", F.col("next").alias("component"))
        else:
            onward = jump.select(F.col("node").alias("component"), "next")
            labels = workspace.save(labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component")), f"{name}-labels{number}")
        moved = links.join(jump.select(F.col("node").alias("src"), F.col("next").alias("a")), "src").join(jump.select(F.col("node").alias("dst"), F.col("next").alias("b")), "dst")
        links = workspace.save(tidy(moved.select(F.col("a").alias("src"), F.col("b").alias("dst"))), f"{name}-links{number + 1}")
        workspace.drop(f"{name}-links{number}", f"{name}-least{number}")
        number += 1
    if labels is None:
        return links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels
