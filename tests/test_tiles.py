"""Ordered operators over tiles, against plain Python and at every tile width."""

from __future__ import annotations

import random

import pytest

from strandline.operators import indexing


def coalesced(rows, gap=0):
    out = []
    for key in {r[0] for r in rows}:
        islands = []
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if islands and s <= islands[-1][1] + gap:
                islands[-1][1], islands[-1][2] = max(islands[-1][1], e), islands[-1][2] + 1
            else:
                islands.append([s, e, 1])
        out += [(key, *i) for i in islands]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1, 7, 64, 1 << 20])
def test_islands_reach_over_tiles(spark, tile):
    r = random.Random(tile)
    rows = [(r.choice(["a", "b", None]), s, s + r.choice([0, 1, 3, 90])) for s in (r.randrange(400) for _ in range(150))]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = indexing.coalesce_intervals(df, ["k"], "s", "e", tile=tile)
    assert got.columns == ["k", "s", "e", "merged"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == coalesced(rows)
    wide = indexing.coalesce_intervals(df, ["k"], "s", "e", 5, tile)
    assert sorted((tuple(x) for x in wide.collect()), key=str) == coalesced(rows, 5)


@pytest.mark.parametrize("tile", [1, 5, 1 << 20])
def test_tilings_offsets_and_lookups(spark, tile):
    whole = [("a", k * 3, k * 3 + 3) for k in range(40)]
    gap = [("b", 0, 3), ("b", 30, 33), ("b", 33, 35)]
    df = spark.createDataFrame([*whole, *gap], "k string, s bigint, e bigint")
    assert {x["k"]: (x["tiles"], x["n"]) for x in indexing.tiles_exactly(df, "k", "s", "e", tile).collect()} == {"a": (True, 40), "b": (False, 3)}
    from pyspark.sql import functions as F

    got = {(x["k"], x["s"]): x["offset"] for x in indexing.running_offsets(df, "k", "s", F.col("e") - F.col("s"), tile).collect()}
    assert all(got["a", 3 * k] == 3 * k for k in range(40)) and [got["b", s] for s in (0, 30, 33)] == [0, 3, 6]
    points = spark.createDataFrame([("a", p) for p in (0, 1, 29, 119, 500)] + [("b", 31), ("c", 1)], "k string, at bigint")
    found = {(x["k"], x["at"]): x["e"] for x in indexing.floor_lookup(points, df, "k", "at", "s", "e", tile).collect()}
    assert found == {("a", 0): 3, ("a", 1): 3, ("a", 29): 30, ("a", 119): 120, ("a", 500): 120, ("b", 31): 33, ("c", 1): None}


@pytest.mark.parametrize("tile", [1, 4, 1 << 20])
def test_order_within_files(spark, tile):
    up = [("up", k, ref, pos) for k, (ref, pos) in enumerate([(0, 1), (0, 1), (0, 9), (2, 3), (2, None), (None, None), (None, None)]) if pos or ref is None]
    rows = [*up, ("back", 0, 0, 9), ("back", 5, 0, 8), ("refs", 1, 1, 1), ("refs", 9, 0, 5), ("unplaced", 0, None, None), ("unplaced", 3, 0, 1)]
    df = spark.createDataFrame(rows, "f string, at bigint, ref int, pos bigint")
    got = {x["f"]: x["sorted"] for x in indexing.sorted_by_file(df, "f", "at", "ref", "pos", tile).collect()}
    assert got == {"up": True, "back": False, "refs": False, "unplaced": False}


def test_light_bins_fold_into_a_parent_that_is_there(spark):
    far = 1 << 40
    rows = [(0, 4681, 0, 5), (0, 585, 0, far), (0, 4682, far, far + (1 << 33)), (0, 73, 0, 9), (0, 4700, 0, 5), (1, 4681, 0, 5)]
    got = sorted(tuple(x) for x in indexing.folded_bins(spark.createDataFrame(rows, "ref_id int, bin int, begin bigint, end bigint")).select("ref_id", "bin", "begin", "end").collect())
    # 4681 is light and 585 there; 4682 is not light; 4700's parent isn't there; 585 is not light
    assert got == [(0, 73, 0, 9), (0, 585, 0, far), (0, 4682, far, far + (1 << 33)), (0, 4700, 0, 5), (1, 4681, 0, 5)]
