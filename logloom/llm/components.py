"""Connected components of a graph of long integers, by alternating large-star and small-star rounds in Spark.

A graph of at most ``SMALL`` links (some hundred kilobytes) is solved by one task instead; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


SMALL = 50_000


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, F.col("a") == F.col("u"))
    pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return joined.select(F.explode(pairs).alias("p")).select("p.*").where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b): the label is the least node of the component. Empty links give no rows."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.limit(SMALL + 1).count() <= SMALL:
        return materialize(edges.coalesce(1).mapInArrow(_in_one_task, "node long, label long"), "components")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
