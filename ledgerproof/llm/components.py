"""Connected components of a link table by alternating stars, with smallest ids as labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links a task holds at once while it thins its own partition.
FOREST_LINKS = 400_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by pointer jumping over arrays."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches):
    """Replace the links of each bounded run of a partition by stars: same components, fewer rows."""
    for pdf in batches:
        for at in range(0, len(pdf), FOREST_LINKS):
            part = pdf.iloc[at: at + FOREST_LINKS]
            nodes, root = roots_of(part["u"].to_numpy(), part["v"].to_numpy())
            away = nodes != root
            yield pd.DataFrame({"u": nodes[away], "v": root[away]})


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node long, component long) for every node that stands in a link (u, v), both long.

    Each round hooks nodes to the least neighbour by a large star, then a small star. Only minima
    are aggregated (map-side combined), no neighbour list is ever collected, and the join on a
    popular node can be split by adaptive execution. Rows with nulls and self links join nothing.
    Every round is written to the shared folder, so a lost executor repeats one round at most.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    links = links.filter("u is not null and v is not null and u <> v").mapInPandas(_forest, "u long, v long")
    edges = materialize(links.distinct(), "links")
    for _ in range(most_rounds):
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        ups, down = F.sum("up"), F.sum(1 - F.col("up"))
        if ends.groupBy("n").agg(ups.alias("ups"), down.alias("down")).filter("ups > 1 or ups = 1 and down > 0").isEmpty():
            break  # every node has one link, to a node without one: stars
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # links now point down: hook every smaller neighbour, and the node itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
