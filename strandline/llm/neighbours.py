"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

A unit vector is rotated by fast Hadamard transforms between random sign flips
and assigned to the signed axis it comes nearest to. Every table has rotations
of its own, and a hash joins as many axes as the number of vectors asks for, so
that buckets keep their size as tables grow. A query looks into the buckets
nearest to it, in every table, and what it finds there is ranked by exact
distance.

The vectors and the queries of a bucket are dealt into blocks of bounded size,
so that one with very many of them is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .staging import Staging, small_side

TABLES = 8
#: Buckets that a query looks at in each table where a hash has one axis, at least; with each further axis three times as many.
PROBES = 10
#: With one axis a query goes on to further buckets until they hold so many vectors, in each table.
LEAST_CANDIDATES = 400
#: Vectors of a bucket on average at most, as long as axes can be added.
BUCKET_VECTORS = 4096
MOST_AXES = 4
#: Vectors of a bucket in one block, on average at most; queries in one block likewise. Fewer where vectors are long.
BLOCK_VECTORS = 4096
BLOCK_NUMBERS = 1 << 22
#: Buckets with their blocks that are sent to every task; more are joined by a shuffle.
LOAD_ROWS = 100_000
ROTATIONS = 3
NEAREST = 10
QUERY_EVERY = 100


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The rows' Walsh-Hadamard transform, scaled to keep lengths; their size is a power of two."""
    size, step = x.shape[1], 1
    while step < size:
        x = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), size)
        step *= 2
    return x / np.sqrt(size)


class CrossPolytope:
    """The hash tables' rotations for vectors of ``size`` components, ``axes`` of them to a hash."""

    def __init__(self, size: int, tables: int = TABLES, axes: int = 1, seed: int = 11):
        self.size, self.padded, self.axes = size, 1 << max(0, int(size - 1).bit_length()), axes
        draw = np.random.default_rng([seed, size])
        self.signs = draw.choice(np.array([-1.0, 1.0]), (axes, tables, ROTATIONS, self.padded))

    def rotated(self, x: np.ndarray, table: int, axis: int = 0) -> np.ndarray:
        y = np.zeros((len(x), self.padded))
        y[:, : self.size] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for signs in self.signs[axis, table]:
            y = _hadamard(y * signs)
        return y

    def scores(self, x: np.ndarray, table: int, axis: int = 0) -> np.ndarray:
        """How near each vector is to each signed axis: the positive ones, then the negative ones."""
        y = self.rotated(x, table, axis)
        return np.hstack([y, -y])

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for axis in range(self.axes):
            code = code * (2 * self.padded) + self.scores(x, table, axis).argmax(axis=1)
        return code

    def near_buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """For each vector the ``probes`` buckets with the largest sums of scores over the axes, among those of each axis's ``probes`` best."""
        code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for axis in range(self.axes):
            scores = self.scores(x, table, axis)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            sums = (total[:, :, None] + np.take_along_axis(scores, best, 1)[:, None]).reshape(len(x), -1)
            codes = (code[:, :, None] * (2 * self.padded) + best[:, None]).reshape(len(x), -1)
            keep = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
            total, code = np.take_along_axis(sums, keep, 1), np.take_along_axis(codes, keep, 1)
        return code


def axes_for(vectors: int, size: int) -> int:
    """Axes of a hash, so that a bucket holds ``BUCKET_VECTORS`` on average at most."""
    axes, buckets = 1, 2 << max(0, int(size - 1).bit_length())
    while axes < MOST_AXES and vectors > BUCKET_VECTORS * buckets**axes:
        axes += 1
    return axes


def usable(vector: str) -> Column:
    """Whether a vector is there, has components, all finite, and isn't zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, vectors, size) for each size in a batch."""
    sizes = np.array(pc.list_value_length(vectors).to_pylist())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size), int(size)


def _scaled(x: np.ndarray) -> np.ndarray:
    """For hashing: scaled by the largest component, lest squares overflow or vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


class Hashing:
    """What a task needs to know: the axes of each size that is hashed, and with one axis how many vectors each bucket holds.

    Vectors of other sizes are few; all of a size are one bucket of table 0.
    """

    def __init__(self, axes: dict[int, int], tables: int, probes: int, least: int):
        self.axes, self.tables, self.probes, self.least = axes, tables, probes, least
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self._known: dict[int, CrossPolytope] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def of(self, size: int) -> CrossPolytope:
        if size not in self._known:
            self._known[size] = CrossPolytope(size, self.tables, self.axes[size])
        return self._known[size]

    def own(self, x: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(table, bucket of each vector)."""
        if size not in self.axes:
            yield 0, np.zeros(len(x), np.int64)
            return
        for t in range(self.tables):
            yield t, self.of(size).buckets(_scaled(x), t)

    def asked(self, x: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, vectors, buckets): a pair for each bucket that a vector looks into."""
        if size not in self.axes:
            yield 0, np.arange(len(x)), np.zeros(len(x), np.int64)
            return
        for t in range(self.tables):
            if self.axes[size] > 1:
                near = self.of(size).near_buckets(_scaled(x), t, self.probes * 3 ** (self.axes[size] - 1))
                yield t, np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
            elif (size, t) in self.held:
                found = probed(self.of(size).scores(_scaled(x), t), self.held[size, t], self.probes, self.least)
                yield t, np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate([*found, np.empty(0, np.int64)])


def probed(scores: np.ndarray, counts: np.ndarray, probes: int, least: int) -> list[np.ndarray]:
    """For each query its buckets that hold vectors, nearest axis first, at least ``probes`` axes and ``least`` vectors."""
    order = np.argsort(-scores, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    # every axis up to the first at which enough is held
    upto = np.maximum(probes, (held < least).sum(axis=1) + 1)
    return [b[:k][counts[b[:k]] > 0] for b, k in zip(order, upto, strict=True)]


_KEYS = ["size", "table_no", "bucket"]


def _keyed(rows: DataFrame, hashing: Hashing, asks: bool) -> DataFrame:
    """(size, table_no, bucket, id, vector): the buckets that vectors are in, or with ``asks`` those that they look into."""
    kind = rows.schema["vector"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(hashing)

    def run(batches):
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            for at, x, size in _matrices(vectors):
                for t, rows_, buckets in shared.value.asked(x, size) if asks else ((t, np.arange(len(x)), c) for t, c in shared.value.own(x, size)):
                    take = pa.array(at[rows_])
                    n = len(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(buckets, pa.int64()), ids.take(take), vectors.take(take)],
                        names=[*_KEYS, "id", "vector"],
                    )

    return rows.select("id", "vector").mapInArrow(run, f"size int, table_no int, bucket bigint, id bigint, vector {kind}")


def _counted(rows: DataFrame, hashing: Hashing, asks: bool, name: str) -> DataFrame:
    """Vectors (or with ``asks`` queries) of each bucket; summed in each batch before anything is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(hashing)

    def run(batches):
        for b in batches:
            for _, x, size in _matrices(b.column(0)):
                for t, *_, buckets in shared.value.asked(x, size) if asks else shared.value.own(x, size):
                    code, n = np.unique(buckets, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), size), pa.int32()), pa.array(np.full(len(code), t), pa.int32()), pa.array(code, pa.int64()), pa.array(n, pa.int64())],
                        names=[*_KEYS, name],
                    )

    return rows.select("vector").mapInArrow(run, f"size int, table_no int, bucket bigint, {name} bigint").groupBy(*_KEYS).agg(F.sum(name).alias(name))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would overflow or vanish, of differences scaled by a power of two."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = vectors - query
        out = np.sqrt((diff * diff).sum(axis=1))
        top = np.abs(diff).max(axis=1, initial=0)
        odd = np.flatnonzero((top > 1e150) & (top < np.inf) | (top > 0) & (top < 1e-150))
        if len(odd):
            scale = 2.0 ** np.floor(np.log2(top[odd]))
            out[odd] = scale * np.sqrt(((diff[odd] / scale[:, None]) ** 2).sum(axis=1))
    return out


def block_nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of each query's nearest in a block, ties to smaller ids, its own id left out.

    Rows of one id are one candidate, at the smallest of their distances: they
    are reduced to it before the limit is set. Products of matrices choose
    candidates with a margin for rounding; their distances are then computed
    from the differences.
    """
    out = []
    largest = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0))
    # only to choose by: squares of very large numbers would overflow
    scale = 2.0 ** -np.ceil(np.log2(largest)) if largest > 1e150 else 1.0
    near_to, asking = vectors * scale, queries * scale
    norms = (near_to * near_to).sum(axis=1)
    order = np.argsort(ids, kind="stable")
    begins = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]]) if len(ids) else np.zeros(0, int)
    repeated = len(begins) < len(ids)
    k = min(nearest, len(begins))
    for at in range(0, len(queries) if k else 0, 256):
        part, part_ids = asking[at : at + 256], query_ids[at : at + 256]
        own = (part * part).sum(axis=1)
        square = own[:, None] + norms[None] - 2 * part @ near_to.T
        square[part_ids[:, None] == ids[None]] = np.inf
        margin = 1e-9 * (own + norms.max()) + 1e-300
        each = np.minimum.reduceat(square[:, order], begins, axis=1) if repeated else square
        limit = np.partition(each, k - 1, axis=1)[:, k - 1]
        for i in range(len(part)):
            near = np.flatnonzero((square[i] <= limit[i] + margin[i]) & (square[i] < np.inf))
            d = distances(vectors[near], queries[at + i])
            best = np.lexsort((ids[near], d))
            seen: set[int] = set()
            for j in best.tolist():
                c = int(ids[near[j]])
                if c not in seen:  # an id may be repeated
                    seen.add(c)
                    out.append((int(part_ids[i]), c, float(d[j])))
                    if len(seen) == nearest:
                        break
    return out


def nearest_neighbours(
    df: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
    least: int = LEAST_CANDIDATES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance): the nearest found of each row for which ``queries`` holds.

    Null, empty and zero vectors, ones with null, NaN or infinite components,
    and rows without id take no part. Vectors are compared with those of their
    size. Repeated ids are one candidate, at the smaller distance, and one
    query, near to what any of its rows is near to. Where at most ``least``
    vectors have a size, everything of it is compared with everything that is
    asked for. An empty table gives an empty one; other columns are ignored.
    """
    staging = Staging(df.sparkSession, "neighbours")
    small_batches(df.sparkSession, 2048)
    element = df.schema[vector].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>" if element == "array<float>" else "array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    # sizes that many vectors have: a handful in any table of embeddings
    sizes = rows.groupBy(F.size("vector").alias("size")).count().where(F.col("count") > least).collect()
    hashing = Hashing({r["size"]: axes_for(r["count"], r["size"]) for r in sizes}, tables, probes, least)
    held = staging.save(_counted(rows, hashing, False, "n"))
    # with one axis there are tables x axes numbers a size, however many vectors there are
    single = [size for size, axes in hashing.axes.items() if axes == 1]
    for r in held.where(F.col("size").isin(single)).collect():
        counts = hashing.held.setdefault((r["size"], r["table_no"]), np.zeros(2 * hashing.of(r["size"]).padded, np.int64))
        counts[r["bucket"]] = r["n"]
    asking = rows.where("asks")
    # buckets that nobody looks into are left out with their vectors
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK_VECTORS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("size"))))
    loads = held.join(_counted(asking, hashing, True, "q"), _KEYS)
    loads = loads.select(*_KEYS, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("q") / block).cast("int").alias("q_blocks"))
    loads = small_side(staging.save(loads), LOAD_ROWS)
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = _keyed(rows, hashing, False).join(loads, _KEYS)
    members = members.select(*_KEYS, dealt(F.col("blocks")).alias("block"), every(F.col("q_blocks")).alias("q_block"), "id", "vector", F.lit(False).alias("asks"))
    asked = _keyed(asking, hashing, True).join(loads, _KEYS)
    asked = asked.select(*_KEYS, every(F.col("blocks")).alias("block"), dealt(F.col("q_blocks")).alias("q_block"), "id", "vector", F.lit(True).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        size = t.column("size")[0].as_py()
        ids = t.column("id").to_numpy()
        x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), size)
        found = block_nearest(ids[asks], x[asks], ids[~asks], x[~asks], nearest) if asks.any() and not asks.all() else []
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*found, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("query_id", "vec_id", "score"), columns, kinds, strict=True)})

    near = members.unionByName(asked).groupBy(*_KEYS, "block", "q_block").applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    once = staging.save(near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    # the rank's limit reaches below the shuffle: no task gathers all that a query found
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
