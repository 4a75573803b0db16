"""Connected components of a link table, by alternating star contraction.

Large-star points every larger neighbour of a node at the smallest one it sees,
small-star does the same with the smaller neighbours; links shrink to stars in a
logarithmic number of rounds. Minima are aggregated before they are joined back,
so a hub with very many links is one row on the small side of a join whose large
side Spark can split. Each task contracts the links it holds to stars, ``CHUNK`` at a
time, before it writes them, which saves rounds and needs no shuffle to drop repeats.
Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm.textbytes import checkpointed


CHUNK = 1_000_000        # links that a task contracts at once


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among these links), other nodes only."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        new, least = low.copy(), np.minimum(low[a], low[b])
        for end in (a, b, low[a], low[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    child = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[child], nodes[low[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the links it holds, as stars."""
    held, n = [], 0

    def stars():
        u, v = contracted(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    for batch in batches:
        held.append(tuple(np.asarray(batch.column(c)) for c in "uv"))
        n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            n = 0
    if n:
        yield stars()


def _star(both: DataFrame, low: DataFrame) -> DataFrame:
    return both.join(low, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node (a long) reachable from each node that has a link.
    Repeated links and links of a node with itself change nothing; links with a null
    end are left out; no links give an empty table."""
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").mapInArrow(_contract, "u long, v long"), "star")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (_star(both, low).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # small star: u keeps its neighbours that are smaller than itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (_star(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v")))
                 .where("u <> v").mapInArrow(_contract, "u long, v long"))
        edges = checkpointed(small, "star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct().toDF("node", "component"))
