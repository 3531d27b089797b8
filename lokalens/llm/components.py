"""Connected components by alternating stars, contracted in each task between the rounds; every round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Edges that a task holds at a time while it contracts them.
RUN_EDGES = 500_000


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if not (open_ := x != y).any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while ((up := label[label]) != label).any():
            label = up


def _contracted(e: DataFrame) -> DataFrame:
    """Stars (u, v), v the smaller, that connect what the edges of e connect: those of a task become its components' nodes with their smallest one, run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nodes, least = least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            own = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(least[own], pa.int64())], ["u", "v"])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            if sum(len(x) for x, _ in held) > RUN_EDGES:
                yield out()
        if held:
            yield out()

    return map_arrow(e.select("u", "v"), run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    least = materialize(least.withColumnRenamed("u", "v"), "least")  # so that a hub's rows can be split in the join
    return e.join(least, "v").select("u", F.col("m").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars already: each node is below one other or above others, not both."""
    ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    most = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) < 2


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that an edge (a, b) of different longs touches; label: the component's smallest node.

    Each task contracts the files that it reads, without a shuffle, for as long as what comes out lies in fewer tasks' files (Spark
    packs them by bytes). What is no star then, as tasks have parts of one component, goes through a round of stars over all edges."""
    e = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "edges")
    while True:
        tasks = e.rdd.getNumPartitions()
        e = materialize(_contracted(e), "contracted")
        if e.rdd.getNumPartitions() >= tasks:
            if _settled(e):
                break
            e = materialize(_small_star(_large_star(e)), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
