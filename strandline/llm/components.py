"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), after each task has contracted its own links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging, join_skewed

#: Links that a task contracts at once, which bounds what it holds.
CHUNK_LINKS = 1 << 19


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for links between nodes 0 to n - 1: roots are hung under smaller ones, paths halved."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        np.minimum.at(parent, high, low)
        while (above := parent[parent]).tobytes() != parent.tobytes():
            parent = above
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components: each task's as (node, smallest node that its links lead to), a chunk at a time."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def solved(held: list):
            t = pa.Table.from_batches(held)
            ends = [t.column(k).combine_chunks() for k in (0, 1)]
            nodes = pc.unique(pa.concat_arrays(ends))
            nodes = nodes.take(pc.sort_indices(nodes))
            a, b = (pc.index_in(e, value_set=nodes).to_numpy() for e in ends)
            root = roots_of(a.astype(np.int64), b.astype(np.int64), len(nodes))
            below = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(below)), nodes.take(pa.array(root[below]))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_LINKS:
                yield solved(held)
                held, n = [], 0
        if n:
            yield solved(held)

    return links.mapInArrow(run, links.schema)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, staging: Staging, rounds: int = 60) -> DataFrame:
    """For ``links`` (a, b) the columns ``node`` and ``root``: the smallest node of its component, for every node but roots.

    Links that one task may hold are solved by one task, which leaves no step
    and writes one file. Of more, tasks contract what they hold, so that few
    steps are left over. Each step attaches neighbours to the smallest one around; the number of
    rounds grows with the logarithm of the nodes squared at most. Minima are
    aggregated before the shuffle, and the links of a node with very many are
    joined where they are. Links to null or to itself say nothing.
    """
    links = links.where("a != b").select("a", "b")
    named = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if links.count() <= CHUNK_LINKS:
        return named(staging.save(_contracted(links.coalesce(1))))
    edges = staging.save(_contracted(links).distinct())
    before = _state(edges)
    for _ in range(rounds):
        if before[0] <= CHUNK_LINKS:
            edges = staging.save(_contracted(edges.coalesce(1)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = staging.save(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = staging.save(join_skewed(both, around, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = staging.save(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_skewed(large, least, "a", "n").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, staging.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        staging.drop(old, around, large, least)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return named(edges)
