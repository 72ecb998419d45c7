"""Nearest neighbours among ids that are repeated many times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.neighbours import block_nearest, nearest_neighbours

from .test_neighbours import brute, table


def test_blocks_hold_nearest_ids_not_rows():
    r = np.random.default_rng(5)
    ids = np.concatenate([np.arange(60), np.repeat([1, 2], 40), np.repeat([3], 11)])
    x = r.normal(size=(len(ids), 6))
    x[60:] = x[0] + r.normal(size=(len(ids) - 60, 6)) * 0.01
    order = r.permutation(len(ids))
    ids, x = ids[order], x[order]
    for q in range(0, 60, 7):
        mine = ids == q
        got = block_nearest(ids[mine], x[mine], ids, x, 10)
        for v in x[mine]:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            want = sorted((float(d[ids == i].min()), int(i)) for i in range(60) if i != q)[:10]
            assert all((q, i, e) in got for e, i in want)
        assert len(got) == 10 * mine.sum()


def test_repeated_ids_leave_room_for_others(spark):
    r = np.random.default_rng(6)
    vectors = [(i, r.normal(size=8).tolist()) for i in range(40)]
    vectors += [(1, vectors[0][1])] * 50 + [(2, (np.array(vectors[0][1]) + 0.01).tolist())] * 30
    rows = nearest_neighbours(table(spark, vectors), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [x["vec_id"] for x in rows] == [i for i, _ in brute(vectors, 0)] and len(rows) == 10
