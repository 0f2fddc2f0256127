"""Connected components of a graph given as a table of links, without gathering them anywhere.

Links are first thinned inside tasks (a spanning forest of what a task holds). Each round is cut in the shared folder.
Steps group by the larger node of a link only, which has few links after thinning; a node that many others point to is
met only in joins that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import cut, tidy

#: Links a task thins at a time; bounds its memory.
THIN = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with root the smallest node of each component of the links given."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _thin(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held.append((a, b))
        size += len(a)
        if size > THIN:
            a, b = forest(*(np.concatenate(c) for c in zip(*held)))
            held, size = [(a, b)], len(a)
            if size > THIN // 2:
                yield out(a, b)
                held, size = [], 0
    if held:
        yield out(*forest(*(np.concatenate(c) for c in zip(*held))))


def components(links: DataFrame, thin: int = THIN) -> DataFrame:
    """links: two long columns (any order, repeats allowed). Returns (node, component_id) of every linked node.

    When what is left fits one task's bound (``thin`` links), that task ends the work; until then, labels fall by
    small-star steps (a node's neighbours are linked to its smallest one) and pointer jumps.
    """
    first, second = links.columns
    edges = links.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).filter("a <> b")
    edges = cut(edges.mapInArrow(tidy(_thin), "a long, b long"))
    while edges.count() > thin:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        star = edges.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()
        star = cut(star)
        up = cut(star.groupBy("a").agg(F.min("b").alias("c")).withColumnRenamed("a", "b"))
        jump = star.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        kept = up.select(F.col("b").alias("a"), F.col("c").alias("b"))
        new = cut(jump.unionByName(kept).distinct())
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            break
        edges = new
    else:
        edges = cut(edges.repartition(1).mapInArrow(tidy(_thin), "a long, b long"))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(roots)
