"""Connected components of a link table by contraction, until what is left is TASK_LINKS links at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, staged

#: Links that one task of a round takes, about.
TASK_LINKS = 100_000


def _finished(batches):
    """(a, to) of every node of at most TASK_LINKS links, to the smallest node of its component."""
    links = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if links:
        a, b = map(np.concatenate, zip(*links))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        least = np.arange(len(nodes))
        while True:
            new = least.copy()
            np.minimum.at(new, x, least[y])
            np.minimum.at(new, y, least[x])
            np.minimum.at(new, least, new.copy())  # a node's head learns what the node learnt
            new = new[new]
            if (new == least).all():
                break
            least = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], names=["a", "to"])


def _renamed(names: DataFrame, into: DataFrame, parts: int) -> DataFrame:
    """names(node, root) with the roots that into(a, to) merges replaced; a root of most nodes is dealt to many tasks."""
    sizes = names.groupBy("root").agg(F.count("*").alias("n"))
    merged = sizes.join(into.select(F.col("a").alias("root"), "to"), "root", "left").select("root", "n", F.coalesce("to", "root").alias("to"))
    keys = staged(merged.coalesce(parts), "roots")
    return staged(join_heavy(names, keys, ["root"], "n", ["node"]).select("node", F.col("to").alias("root")).coalesce(parts), "names")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root) for every node of a link; root is any one node of its component.

    In each round every node is merged into the neighbour (or itself) that a hash of the round puts first; links between
    different nodes go on to the next round. The hash makes the expected number of rounds logarithmic, on chains too. The
    last TASK_LINKS links are finished by one task. Nodes with very many links and roots of very many nodes are dealt to
    several tasks in every join.
    """
    pairs = links.where(F.col("a") != F.col("b")).select("a", "b")
    edges = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n = edges.count()
    parts = 1 + n // TASK_LINKS  # later rounds have fewer links: few tasks and files for few links
    names = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")).coalesce(parts)
    step = 0
    while n > TASK_LINKS:
        first = F.min(F.struct(F.xxhash64("b", F.lit(step)).alias("h"), F.col("b").alias("node"))).alias("near")
        own = F.struct(F.xxhash64("a", F.lit(step)).alias("h"), F.col("a").alias("node"))
        hooks = edges.groupBy("a").agg(first, F.count("*").alias("links"))
        into = staged(hooks.select("a", F.least(own, F.col("near"))["node"].alias("to"), "links").coalesce(parts), "hooks")
        names = _renamed(names, into, parts)
        # each link stands in both directions, so a node is as often the second end as the first
        half = join_heavy(edges, into, ["a"], "links", ["b"]).select(F.col("a").alias("end"), F.col("to").alias("x"), F.col("b").alias("a"))
        both = join_heavy(half, into, ["a"], "links", ["end"]).select(F.col("x").alias("a"), F.col("to").alias("b"))
        edges = staged(both.where("a != b").distinct().coalesce(parts), "edges")
        n = edges.count()
        step += 1
    if n:
        names = _renamed(names, edges.select("a", "b").coalesce(1).mapInArrow(_finished, "a long, to long"), parts)
    return names
