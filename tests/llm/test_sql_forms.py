"""Operators with SQL: their queries against DuckDB on small tables with odd rows."""

from __future__ import annotations

import random

import duckdb
import pytest

from strandline.llm.lines import drop_boilerplate, line_report
from strandline.llm.mixing import mix, mixed_rows
from strandline.llm.queries import ORACLES

from .conftest import ODD


def in_duckdb(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(str(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in cur.fetchall()))


def rows_of(df):
    return sorted(tuple(str(r[n]) for n in sorted(df.columns)) for r in df.collect())


def pages(seed, n=130):
    r = random.Random(seed)
    lines = [f"line {k}" for k in range(60)] + ["", "  ", "\t"]
    rows = []
    for i in range(n):
        body = [r.choice(lines) for _ in range(r.randrange(1, 8))]
        if r.random() < 0.3:
            body.insert(0, "menu")
        if r.random() < 0.05:
            body = ["menu", "menu"]
        rows.append((i, "\n".join(body), "en", r.choice(["a", "a", "a", "b", None, "rare" if i % 40 == 0 else "c"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(docs, seed):
    df = docs([*pages(seed), *ODD], clashing=False)
    got = rows_of(line_report(df))
    assert got == in_duckdb(df, ORACLES["op2_line_dedup"])
    assert any(x[2] != "0" for x in got)


def test_cleaned_rows_keep_their_columns(docs):
    df = docs([*pages(3), *ODD])
    out = drop_boilerplate(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("text = 'menu\nmenu'").count() == df.where("text = 'menu\nmenu'").count() > 0
    before = {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}
    for r in out.where("source = 'a' and doc_id is not null and text like '%menu%'").collect():
        assert r["text"] == before[r["doc_id"]]  # nothing but boilerplate: left whole
    assert df.where("source = 'a' and text like '%menu%'").count() > out.where("source = 'a' and text like '%menu%'").count()
    assert drop_boilerplate(df.limit(0)).count() == 0 and line_report(df.limit(0)).count() == 0


def words(seed, n=200, sources=("a", "a", "a", "a", "b", "c", None, "d", "é")):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 3, 20, 200])), "en", r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("rows", [words(1), words(2, 40), words(3, 30, ("one",)), [*words(4, 60), *ODD], [(1, None, None, None)], [(1, "a b c", None, "x")]])
def test_mixes(docs, rows):
    df = docs(rows, clashing=False)
    got = rows_of(mix(df))
    assert got == in_duckdb(df, ORACLES["op8_mixing"]) == rows_of(mix(df))


def test_targets_and_copies(docs):
    rows = words(5, 600)
    df = docs(rows)
    got = mix(df).collect()
    by_source = {}
    for (_, _, _, s), r in zip(sorted(rows), sorted(got, key=lambda r: r["doc_id"]), strict=True):
        t = by_source.setdefault(s, [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(t[2] for t in by_source.values())
    assert abs(sum(t[1] for t in by_source.values()) - 1.5 * total) < 1e-6
    for taken, target, size in by_source.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 100
    out = mixed_rows(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in got:
        if r["size"]:
            assert counts.get(r["doc_id"], 0) * r["size"] == r["taken"]
    assert mix(df.limit(0)).count() == 0 and mixed_rows(df.limit(0)).count() == 0


def test_inclusion_differs_by_document(docs):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([4, 100, 400])), "en", "b" if i % 4 else "a") for i in range(1200)]
    got = mix(docs(rows)).where("target < 2 * source_size").collect()
    mean = {n: sum(x["taken"] / n for x in part) / len(part) for n in (4, 100, 400) for part in [[x for x in got if x["size"] == n]]}
    # copies due grow with one and the square root of the size: 3, 11 and 21 parts
    assert 0.15 < mean[4] / mean[400] * 7 < 2.0 and 0.75 < mean[100] / mean[400] * 21 / 11 < 1.25
    assert mean[4] < mean[100] < mean[400]
