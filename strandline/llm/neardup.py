"""Near-duplicates by circulant MinHash with exact verification (operator 5).

Two permutations make a whole signature: the first scatters shingles over a
circle, the second, shifted round the circle step by step, gives one minimum a
step. The values that a shingle meets in all shifts lie next to each other in
the second permutation, so a signature is the minimum over windows of one
table. Equal bands of a signature make candidates; the Jaccard similarity of
their full shingle sets decides.

Texts with equal shingle sets are one class from the start. In each bucket
every class is first held against a pivot, so that pairs grow with classes.
What that links is joined, and in buckets that are one component then nothing
is left to find. In the others the pairs between components are compared: of
buckets of at most ``SMALL_BUCKET`` classes one by one, of larger ones in
blocks, where the classes outside the largest component meet all of the
bucket, and each pair of blocks is one task that returns a spanning forest of
its links. Only pairs that are linked through others already are left out, so
no component is lost and nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, hand_back, small_batches
from .components import components
from .shingles import mix, shingle_sets
from .staging import Staging, join_skewed, small_side, tasks_for

CIRCLE_BITS = 20
#: Sets of more shingles would fill that circle; they are hashed on one of 2^64 places. Those a little smaller are on both.
CROWDED = 1 << 17
#: Rows of a band and bands. A pair at the threshold 0.85 is missed with probability (1 - 0.85^6)^36 = 4e-8.
BAND_ROWS = 6
BANDS = 36
#: Words in a shingle, and the least similarity in percent.
SHINGLE_WORDS = 5
SIMILARITY = 80
SMALL_BUCKET = 64
#: Pivots of a larger bucket; a small one has one. They are the classes whose prints come first in an order that all
#: buckets share, so that buckets with the same classes have the same ones.
PIVOTS = 2
#: Tasks that the pairs of one pivot are dealt over.
SALTS = 16
#: Rows of bucket counts, ids or fingerprints that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Classes and shingles that a block of a larger bucket holds on average at most.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1 << 20
#: Pairs, and bytes of their shingles, that a task compares, bucket counts and bytes of shingles that it writes, unless
#: tasks have fewer.
TASK_PAIRS = 1024
TASK_PAIR_BYTES = 1 << 22
TASK_BUCKETS = 1 << 15
TASK_BYTES = 1 << 20
#: Columns of the incidence matrix that are held at once.
MATRIX_COLUMNS = 2048


class CirculantMinHash:
    """Signatures of shingle sets; sets of which the smaller has ``percent`` of the larger one's shingles share a circle."""

    def __init__(self, rows: int = BAND_ROWS, bands: int = BANDS, seed: int = 1, percent: int = SIMILARITY):
        self.rows, self.bands, self.seed, self.percent = rows, bands, seed, percent
        second = np.random.default_rng(seed).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        around = np.concatenate([second, second[: rows * bands]])
        self.windows = np.lib.stride_tricks.sliding_window_view(around, rows * bands)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        # the first permutation is a bijection of 64-bit shingles; its upper bits are the place on the circle
        places = (mix(shingles ^ np.uint64(self.seed)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
        out = self.windows[places[:1024]].min(axis=0)
        for at in range(1024, len(places), 1024):
            out = np.minimum(out, self.windows[places[at : at + 1024]].min(axis=0))
        return out

    def wide_signature(self, shingles: np.ndarray) -> np.ndarray:
        """The same on a circle of 2^64 places, where both permutations are computed."""
        out = np.full(self.rows * self.bands, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1 << 15):
            places = mix(shingles[at : at + (1 << 15)] ^ np.uint64(self.seed))
            for k in range(len(out)):
                out[k] = min(out[k], mix((places + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)).min())
        return out

    def keys(self, shingles: np.ndarray) -> list[int]:
        """One bucket key for each band and circle; none for the empty set, which is like nothing."""
        if not len(shingles):
            return []
        out: list[int] = []
        if len(shingles) <= CROWDED:
            out += self._keys(self.signature(shingles), 0)
        if 100 * len(shingles) >= self.percent * CROWDED:
            out += self._keys(self.wide_signature(shingles), self.bands)
        return out

    def _keys(self, signature: np.ndarray, first: int) -> list[int]:
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(first, first + self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return key.view(np.int64).tolist()


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(a: int, b: int, both: int, percent: int) -> bool:
    """Whether sets of ``a`` and ``b`` shingles with ``both`` in common are alike enough."""
    return 100 * both >= percent * (a + b - both) and both > 0


def _decode(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _with_arrow(df: DataFrame, fields: str, rows_of) -> DataFrame:
    """mapInArrow with plain Python: ``rows_of`` gets a batch's columns as lists and returns rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(*(c.to_pylist() for c in b.columns))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        hand_back()

    return df.mapInArrow(run, fields)


def describe(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """For each row its key, the size and fingerprint of its shingle set, and its bucket keys.

    Fingerprint and keys are null where the row can't be linked: without id, text or words.
    """
    def make():
        hasher = CirculantMinHash(percent=percent)

        def run(texts):
            sizes, prints, keys = [], [], []
            for s in shingle_sets(texts, words):
                sizes.append(len(s))
                prints.append(fingerprint(s) if len(s) else None)
                keys.append(np.array(hasher.keys(s), np.int64).tobytes() if len(s) else None)
            return sizes, prints, keys

        return run

    return annotate(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), ["text"], "n bigint, print binary, bands binary", make, ["id"])


def _order() -> Column:
    return F.xxhash64("print")


def _alike_in_size(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _small_pivot_pairs(small: DataFrame, percent: int) -> DataFrame:
    """(class, pivot, shingles of both) for the classes of small buckets whose sizes allow a link; one shuffle."""
    lists = small.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(_order().alias("o"), "print", "n"))).alias("m"))
    star = lists.select(F.get("m", F.lit(0)).alias("p"), F.explode(F.slice("m", 2, SMALL_BUCKET)).alias("x"))
    return star.where(_alike_in_size(F.col("x.n"), F.col("p.n"), percent)).select(F.col("x.print").alias("a"), F.col("p.print").alias("b"), (F.col("x.n") + F.col("p.n")).alias("n")).distinct()


def _pivot_pairs(large: DataFrame, percent: int) -> DataFrame:
    """(class, pivot, shingles of both) for the classes of large buckets whose sizes allow a link."""
    pivots = large.groupBy("bucket", F.pmod(_order(), F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("print", "n"), _order()).alias("p"))
    pivots = small_side(pivots.select("bucket", F.col("p.print").alias("b"), F.col("p.n").alias("m")), BROADCAST_ROWS)
    sizes = _alike_in_size(F.col("n"), F.col("m"), percent)
    return large.join(pivots, "bucket").where(sizes & (F.col("print") != F.col("b"))).select(F.col("print").alias("a"), "b", (F.col("n") + F.col("m")).alias("n")).distinct()


def _left_pairs(rooted: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of a small bucket that are of different components so far and weren't held against each other."""
    one = F.struct(_order().alias("o"), "print", "n", "root")
    lists = rooted.groupBy("bucket").agg(F.sort_array(F.collect_list(one)).alias("m")).where(F.size(F.array_distinct(F.transform("m", lambda x: x["root"]))) > 1)
    # the first one is the pivot, which all others have met
    first = lists.select("m", F.posexplode("m").alias("i", "x")).where("i > 0")
    pairs = first.select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL_BUCKET)).alias("y"))
    pairs = pairs.where((F.col("x.root") != F.col("y.root")) & _alike_in_size(F.col("x.n"), F.col("y.n"), percent))
    return pairs.select(F.col("x.print").alias("a"), F.col("y.print").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = 1) -> DataFrame:
    """The pairs, a table, whose full sets are alike. With ``salts`` the pairs of one ``b`` are dealt over so many tasks."""
    compared, shingles = pairs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(tasks_for(compared, TASK_PAIRS), tasks_for(8 * shingles, TASK_PAIR_BYTES))
    pairs = pairs.select("a", "b")
    left = sets.select(F.col("print").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("print").alias("b"), F.col("shingles").alias("y"))
    if salts > 1:
        right = right.join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        joined = pairs.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "x", "y")
    else:
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def rows(a, b, x, y):
        out = []
        for p, q, s, t in zip(a, b, map(_decode, x), map(_decode, y), strict=True):
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            if linked(len(s), len(t), both, percent):
                out.append((p, q))
        return out

    return _with_arrow(joined.coalesce(tasks), "a binary, b binary", rows)


def block_forest(prints: list[bytes], sets: list[np.ndarray], sides: np.ndarray, same: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between two blocks (or within one, if ``same``).

    Common shingles are counted by products of incidence matrices over a few
    thousand shingles at a time; shingles of a single class can't be common.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, column, uses = np.unique(values, return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    x, y = (np.flatnonzero(~sides), np.flatnonzero(sides)) if not same else (np.arange(len(sets)), np.arange(len(sets)))
    place = np.zeros(len(sets), np.int64)
    place[x] = np.arange(len(x))
    place_y = np.zeros(len(sets), np.int64)
    place_y[y] = np.arange(len(y))
    both = np.zeros((len(x), len(y)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        r, c = rows[lo:hi], column[lo:hi] - at
        left = np.zeros((len(x), MATRIX_COLUMNS), np.float32)
        in_x = np.ones(len(r), bool) if same else ~sides[r]
        left[place[r[in_x]], c[in_x]] = 1
        if same:
            right = left
        else:
            right = np.zeros((len(y), MATRIX_COLUMNS), np.float32)
            right[place_y[r[~in_x]], c[~in_x]] = 1
        both += left @ right.T  # counts below 2^24 are exact
    n = np.array([len(s) for s in sets])
    both = both.astype(np.int64)
    links = 100 * both >= percent * (n[x][:, None] + n[y][None] - both)
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(x, y)] = links
    near[np.ix_(y, x)] |= links.T
    out, new = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not new[start]:
            continue
        new[start] = False
        reached = [start]
        while reached:
            i = reached.pop()
            found = np.flatnonzero(near[i] & new)
            new[found] = False
            reached += found.tolist()
            out += [(prints[i], prints[j]) for j in found.tolist()]
    return out


def _left_over(joined: DataFrame, staging: Staging) -> DataFrame:
    """The blocks to be compared: (bucket, i, j, side, print).

    In each large bucket of several components the classes outside the
    component with most of them (side false, block i) meet all classes (side
    true, block j). With m of c classes outside there are some 2 m c /
    ``BLOCK_CLASSES`` rows; none where all are linked already.
    """
    per = joined.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    need = lambda c, total: F.greatest(F.lit(1), F.ceil(F.greatest(c / BLOCK_CLASSES, total / BLOCK_SHINGLES)).cast("int"))
    whole = per.groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("c"), F.sum("total").alias("total"),
        F.max(F.struct("c", "root", "total")).alias("most"), F.count("*").alias("roots"),
    ).where("roots > 1")
    whole = staging.save(
        whole.select(
            "bucket", "main", need(F.col("c"), F.col("total")).alias("blocks"),
            need(F.col("c") - F.col("most.c"), F.col("total") - F.col("most.total")).alias("outside"),
        )
    )
    rows = joined.join(small_side(whole, BROADCAST_ROWS), "bucket")
    own = lambda n: F.pmod(F.xxhash64("print"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = rows.where(F.col("root") != F.col("main")).select("bucket", own(F.col("outside")).alias("i"), every(F.col("blocks")).alias("j"), F.lit(False).alias("side"), "print")
    inside = rows.select("bucket", every(F.col("outside")).alias("i"), own(F.col("blocks")).alias("j"), F.lit(True).alias("side"), "print")
    return outside.unionByName(inside)


def _blocks(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between blocks, a pair of blocks a task."""
    import pyarrow as pa

    joined = dealt.join(sets, "print").select("bucket", "i", "j", "side", "print", "shingles")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("print", "ascending")])
        prints = t.column("print").to_pylist()
        sets_ = [_decode(s) for s in t.column("shingles").to_pylist()]
        found = block_forest(prints, sets_, np.array(t.column("side").to_pylist(), bool), False, percent)
        found = [(p, q) for p, q in found if p != q]  # a class may be on both sides
        hand_back()
        return pa.table({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary())})

    return joined.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _joined_roots(roots: DataFrame, links: DataFrame, staging: Staging) -> DataFrame:
    """(node, root) of components that further links join: only their roots are linked anew."""
    if links.isEmpty():
        return roots
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = staging.save(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b").distinct(), most=links.count())
    above = components(between, staging)
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return staging.save(moved.unionByName(above.select("node", "root")))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILARITY
) -> DataFrame:
    """One row for each row of ``docs``: key, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest key reachable over links, a row's own
    included; ``kept`` is true for the row of that key. A row with an empty or
    null text is linked with nothing. A row without a key is linked with
    nothing either: its component is null and it is not kept. Rows that
    repeat a key are documents of their own, joined only by their texts;
    of rows with the same key and shingles all are kept or none. Very long
    texts are hashed and compared whole. An empty table gives an empty one;
    other columns are ignored.
    """
    staging = Staging(docs.sparkSession, "neardup")
    small_batches(docs.sparkSession)
    base = staging.save(describe(docs, key, text, words, percent))
    usable = base.where("id is not null and print is not null")
    classes = staging.save(
        usable.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")),
        most=base.count(),
    )

    # bucket keys are decoded in the JVM: eight bytes each
    at = F.explode(F.sequence(F.lit(1), F.octet_length("bands") - 7, F.lit(8)))
    rows = classes.select("print", "n", "bands", at.alias("at")).select("print", "n", F.substring("bands", F.col("at"), F.lit(8)).alias("bucket"))
    buckets = staging.save(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), most=BANDS * classes.count() // 2, each=TASK_BUCKETS)
    members = staging.save(rows.join(small_side(buckets, BROADCAST_ROWS), "bucket"))
    small, large = members.where(F.col("c") <= SMALL_BUCKET), members.where(F.col("c") > SMALL_BUCKET)
    some_large = not large.isEmpty()
    n_members = members.count()
    needed = staging.save(members.select("print", "n").distinct().join(classes.select("print", "id"), "print"), most=n_members)
    set_bytes = 8 * (needed.agg(F.sum("n")).first()[0] or 0)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(small_side(needed.select("print", "id"), BROADCAST_ROWS), "id").select("print", "text")

    def shingled(prints, rows):
        sets = shingle_sets(rows, words)
        return [(p, s.tobytes()) for p, s in zip(prints, sets, strict=True) if fingerprint(s) == p]

    sets = staging.save(_with_arrow(texts, "print binary, shingles binary", shingled).dropDuplicates(["print"]), most=set_bytes, each=TASK_BYTES)
    links = _verified(staging.save(_small_pivot_pairs(small, percent), most=n_members), sets, percent)
    if some_large:
        links = links.unionByName(_verified(staging.save(_pivot_pairs(large, percent), most=PIVOTS * n_members), sets, percent, SALTS))
    roots = components(staging.save(links), staging)
    rooted = members.join(roots.select(F.col("node").alias("print"), "root"), "print", "left")
    rooted = staging.save(rooted.select("bucket", "print", "n", "c", F.coalesce("root", "print").alias("root")))
    left = staging.save(_left_pairs(rooted.where(F.col("c") <= SMALL_BUCKET), percent))
    more = _verified(left, sets, percent)
    if some_large:
        more = more.unionByName(_blocks(staging.save(_left_over(rooted.where(F.col("c") > SMALL_BUCKET), staging)), sets, percent))
    roots = _joined_roots(roots, staging.save(more), staging)

    # smallest key of each component, then of each class; classes without links are their own component
    in_links = staging.save(
        roots.select(F.col("node").alias("print"), "root").unionByName(roots.select(F.col("root").alias("print"), "root").distinct()).join(classes.select("print", "id"), "print")
    )
    least = staging.save(in_links.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("classes")), most=in_links.count())
    of_class = join_skewed(in_links.select("print", "root"), least, "root", "classes").select("print", "component_id")
    found = staging.save(
        classes.select("print", "id", "copies").join(of_class, "print", "left").select("print", F.coalesce("component_id", "id").alias("component_id"), "copies"),
        most=classes.count(),
    )
    # the result is read from ``base`` and ``found``
    staging.drop(classes, buckets, members, needed, sets, rooted, left, in_links, least)
    # rows that can't be linked must not meet in one task on a null key
    out = join_skewed(usable.select("id", "n", "print"), found, "print", "copies").select("id", "n", "component_id")
    rest = base.where("id is null or print is null").select("id", "n", F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest key stays.

    Rows without key stay, as nothing tells them apart. Of rows that repeat a
    key and a text one stays; a repeated key goes only if none of its rows is
    to be kept.
    """
    staging = Staging(docs.sparkSession, "one-of-each")
    found = staging.save(near_duplicates(docs, key, text, words, percent).where("component_id is not null or n_shingles = 0"))
    known = found.where(F.col(key).isNotNull())
    per_key = staging.save(known.groupBy(key).agg(F.max(F.coalesce("kept", F.lit(False))).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    out = docs.join(small_side(per_key.where("not kept").select(key), BROADCAST_ROWS), key, "left_anti").select(docs.columns)
    repeated = per_key.where("kept").select(key)
    if repeated.isEmpty():
        return out
    several = out.join(small_side(repeated, BROADCAST_ROWS), key, "left_semi").select(docs.columns)
    return out.join(small_side(repeated, BROADCAST_ROWS), key, "left_anti").select(docs.columns).unionByName(several.dropDuplicates([key, text]))
