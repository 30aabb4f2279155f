"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import discard, materialize, shared_dir, ship  # noqa: F401

ARROW_ROWS = 1000
ONE_TASK_EDGES = 500_000


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches so that a batch of long texts fits a Python worker.

    Spark reads that bound when a lazy result is at last computed, so that it
    stays set in the session; a lower one is left as it is.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of n nodes over links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def _solve(batches):
    """(node, root) of all edges (u, v) of one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(c) for c in zip(*parts))
    nodes = np.unique(np.concatenate([u, v]))
    root = nodes[smallest_labels(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))]
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(root[at : at + 100_000])], ["node", "root"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (a long, b long).

    Up to one_task distinct edges, a bound of 16 bytes each, are solved in one
    task. Beyond, it alternates the large-star and small-star steps until
    nothing changes; each round is written to the shared folder. Hubs are
    safe: minima are partially aggregated, and the joins back are plain
    equi-joins that adaptive execution may split. Null ends and loops are
    ignored; nodes without an edge do not appear.
    """
    label = "components"
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, label)
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        if now[0] <= one_task:
            solved = materialize(e.repartition(1).mapInArrow(_solve, "node long, root long"), label)
            discard(e)
            return solved
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(low2.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), label)
        discard(last)
