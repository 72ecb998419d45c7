from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.llm.components import components
from strandline.llm.neardup import BAND_ROWS, BANDS, CirculantMinHash, block_forest, linked, near_duplicates, one_of_each
from strandline.llm.shingles import shingle_sets
from strandline.llm.staging import Staging

from .conftest import ODD


def plain_set(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    """component of each row: smallest id reachable."""
    sets = [plain_set(t, words) if i is not None else set() for i, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [None if rows[i][0] is None else min(rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None) for i in range(len(rows))], [len(plain_set(t, words)) for _, t in rows]


def some_rows(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([2, 5, 40, 90]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i * 3 % 127, " ".join(w).title() if r.random() < 0.3 else "\t".join(w)))
    return rows


def test_shingles_equal_plain_sets():
    texts = ["a b c d", "A b\tC  d\n", "x", "", None, " \n", "one two", "é b c é b c", "a b c a b c a b c", "b c"] * 2
    for words in (1, 3, 5):
        found = list(shingle_sets(texts, words))
        for t, s in zip(texts, found, strict=True):
            assert len(s) == len(plain_set(t, words)) and (np.diff(s.astype(object)) > 0).all()
        for a, x in zip(texts, found, strict=True):
            for b, y in zip(texts, found, strict=True):
                assert len(np.intersect1d(x, y)) == len(plain_set(a, words) & plain_set(b, words))


def test_signatures_estimate_similarity():
    h, r = CirculantMinHash(), np.random.default_rng(1)
    hits = []
    for _ in range(40):
        a = r.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[:360], r.integers(0, 2**63, 40).astype(np.uint64)])
        hits.append((h.signature(a) == h.signature(b)).mean())
        assert set(h.keys(a)) & set(h.keys(b)) or (h.signature(a) == h.signature(b)).mean() < 0.6
    assert abs(np.mean(hits) - 360 / 440) < 0.02
    assert h.keys(np.empty(0, np.uint64)) == [] and len(h.keys(a)) == BANDS and len(h.signature(a)) == BANDS * BAND_ROWS


def test_block_forests_join_what_is_linked():
    r = random.Random(1)
    for _ in range(150):
        base, sets = list(range(40)), []
        for _ in range(r.randrange(2, 25)):
            s = set(base)
            for _ in range(r.randrange(8)):
                s.discard(r.choice(base))
                s.add(r.randrange(1000))
            sets.append(np.unique(np.array(sorted(s) if r.random() > 0.1 else [r.randrange(1000, 2000)], np.uint64)))
        sides, same = np.array([r.random() < 0.5 for _ in sets]), r.random() < 0.5
        got = block_forest([bytes([i]) for i in range(len(sets))], sets, sides, same, 85)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (same or sides[i] != sides[j]) and linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), 85)]

        def groups(edges):
            parent = list(range(len(sets)))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in edges:
                parent[max(find(a), find(b))] = min(find(a), find(b))
            return [find(i) for i in range(len(sets))]

        want = groups(pairs)
        assert groups([(a[0], b[0]) for a, b in got]) == want and len(got) == len(sets) - len(set(want))


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(60)] + [(400, 400 + k) for k in range(1, 50)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint"), Staging(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Staging(spark, "t")).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(docs, words, percent):
    rows = some_rows(words)
    got = {r["doc_id"]: r for r in near_duplicates(docs([(*x, "en", "s") for x in rows]), words=words, percent=percent).collect()}
    comp, sizes = brute(rows, words, percent)
    for (i, _), c, n in zip(rows, comp, sizes, strict=True):
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (c, n, i == c)


def test_large_buckets_go_by_blocks(docs, monkeypatch):
    from strandline.llm import neardup

    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 4)
    rows = some_rows(9)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs([(*x, "en", "s") for x in rows]), words=3, percent=85).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows, 3, 85)[0], strict=True))


def test_odd_rows(docs):
    df = docs([*ODD, (9, "same text here", None, None), (8, "SAME  text\nhere", None, None), (None, "same text here", None, None)])
    rows = near_duplicates(df, words=3, percent=85).collect()
    assert len(rows) == df.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[4] == [(1, 4, True)] * 2 and by_id[8] == by_id[9] == [(1, 4, False)]
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and sorted(by_id[None]) == [(0, None, False), (1, None, False)]
    assert near_duplicates(df.limit(0)).count() == 0
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert one_of_each(df.limit(0)).count() == 0


def test_rows_in_a_large_bucket_of_near_copies(spark, docs, monkeypatch):
    """Near-copies meet pivots first; what is then compared in blocks is little, and nothing is lost by it."""
    from strandline.llm import neardup

    monkeypatch.setattr(neardup, "SMALL_BUCKET", 8)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 16)
    sizes = {"pairs": 0, "dealt": 0}
    left_over, left_pairs = neardup._left_over, neardup._left_pairs

    def counted(name, f):
        def run(*args):
            out = f(*args)
            sizes[name] += out.count()
            return out

        return run

    monkeypatch.setattr(neardup, "_left_over", counted("dealt", left_over))
    monkeypatch.setattr(neardup, "_left_pairs", counted("pairs", left_pairs))
    r = random.Random(12)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:150] + [f"y{i}z{k}" for k in range(150)])) for i in range(40)]  # alike, but not enough
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs([(*x, "en", "s") for x in rows]), words=3, percent=85).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}
    # blocks alone would take 400 * 400 / 16 rows in every band
    assert sizes["dealt"] < 400 * 400 / 16 and sizes["pairs"] < 400 * 36


def test_very_long_sets_share_a_wide_circle(monkeypatch):
    from strandline.llm import neardup

    r = np.random.default_rng(2)
    monkeypatch.setattr(neardup, "CROWDED", 1000)
    h = CirculantMinHash(percent=80)
    for n in (700, 900, 1000, 1001, 1200, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.97)], r.integers(0, 2**63, max(1, int(n * 0.02))).astype(np.uint64)]))
        assert set(h.keys(a)) & set(h.keys(b))
        assert not set(h.keys(a)) & set(h.keys(np.unique(r.integers(0, 2**63, n).astype(np.uint64))))
        assert len(h.keys(a)) == BANDS * ((n <= 1000) + (n >= 800))
    assert abs(np.mean([(h.wide_signature(x) == h.wide_signature(np.concatenate([x[:900], y]))).mean() for x, y in ((r.integers(0, 2**63, 1000).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(20))]) - 900 / 1100) < 0.03


def test_built_words_are_told_apart():
    a, b = "0", "1"
    for _ in range(11):
        a, b = a + b, b + a  # sequences on which polynomials modulo powers of two agree
    (x,), (y,) = shingle_sets([a, b], 3)
    assert x != y and len(a) == 2048


def test_links_are_contracted_in_each_task(spark, monkeypatch):
    from strandline.llm import components as C

    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 60))
        a, b = r.integers(0, n, 40), r.integers(0, n, 40)
        got, want = C.roots_of(a, b, n), list(range(n))
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert got.tolist() == want
    chain = [(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(3000)]
    assert (C.roots_of(np.arange(3000), np.arange(1, 3001), 3001) == 0).all()
    for chunk in (7, 1 << 19):
        monkeypatch.setattr(C, "CHUNK_LINKS", chunk)
        found = components(spark.createDataFrame(chain[::-1], "a binary, b binary").repartition(3), Staging(spark, "t")).collect()
        assert {bytes(x["root"]) for x in found} == {b"0000"} and len(found) == 3000
    # every link of a task's chunk leads to the smallest node of its component there
    one = C._contracted(spark.createDataFrame([(5, 3), (3, 9), (8, 7), (7, 8)], "a bigint, b bigint").coalesce(1)).collect()
    assert sorted(map(tuple, one)) == [(5, 3), (8, 7), (9, 3)]


def test_few_links_take_one_task(spark, monkeypatch):
    from strandline.llm import components as C

    links = [(k, k + 1) for k in range(300)] + [(500 + k, 500) for k in range(1, 100)] + [(7, 7), (None, 3)]
    want = {**dict.fromkeys(range(1, 301), 0), **dict.fromkeys(range(501, 600), 500)}
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(8)
    tables = []
    # all links at once, all links once each task has contracted its own, never
    for chunk in (399, 398, 50):
        monkeypatch.setattr(C, "CHUNK_LINKS", chunk)
        staging = Staging(spark, "t")
        got = {x["node"]: x["root"] for x in components(df, staging).collect()}
        assert got == want
        tables.append(staging.tables)
    assert tables[0] == 1 and tables[1] > 1 and tables[2] > 3


def test_few_files_for_small_tables(spark, docs, monkeypatch):
    """A file is made by a task, and on a local file system by three processes: with many partitions a small table had thousands."""
    import os

    files = []

    class Counting(Staging):
        def save(self, df, *args, **named):
            out = super().save(df, *args, **named)
            path = self.paths[id(out)][1].removeprefix("file:")
            files.append(sum(x.startswith("part-") for x in os.listdir("/" + path.lstrip("/"))))
            return out

    monkeypatch.setattr("strandline.llm.neardup.Staging", Counting)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in names]
    rows = some_rows(3)
    try:
        for k, v in zip(names, ("60", "false"), strict=True):
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs([(*x, "en", "s") for x in rows]), words=3, percent=85).collect()}
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)
    assert got == dict(zip([i for i, _ in rows], brute(rows, 3, 85)[0], strict=True))
    assert sum(files) < 200
