"""The pipeline's stages against plain Python on a small corpus."""

from __future__ import annotations

import base64
import random

import public_tokenizers as vocab
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm.queries import QUERIES

from .test_langid import corpus


def documents():
    r = random.Random(1)
    rows = []
    for i, text, lang, _ in corpus(90):
        w = text.split()
        body = [" ".join(r.sample(w, len(w))) + f" n{i}x n{i}y n{i}z n{i}u" for _ in range(3)]
        rows.append((i, "\n".join(["menu of the site", *body]), lang, "ab"[i % 2]))
    rows += [(200 + i, t.replace("menu of the site\n", ""), la, s) for i, t, la, s in rows[:10]]
    rows += [(300, "1234 5678", "en", "a"), (301, None, "en", "a"), (302, "", None, None)]
    return rows


def test_stages(spark, docs, tmp_path):
    made = documents()
    docs(made, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "mixing", "byte-level BPE"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
        assert k == 4 or now.columns == columns
    language, lines, near, mixed, tokens = seen
    # the ones without letters go, and nothing else
    assert sorted(r["doc_id"] for r in language) == sorted(i for i, *_ in made if i < 300)
    # the menu stands on nearly every page
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t.replace("menu of the site\n", "") for i, t, *_ in made if i < 300}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    # what is then equal stays once, by the smallest id
    assert sorted(r["doc_id"] for r in near) == list(range(90))
    words = {s: sum(len(r["text"].split()) for r in near if r["source"] == s) for s in "ab"}
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in "ab"}
    total = sum(words.values())
    level = 1.5 * total / 4
    want = {"a": min(2 * words["a"], 3 * level)}
    want["b"] = min(2 * words["b"], 1.5 * total - want["a"])
    assert all(abs(taken[s] - want[s]) <= 30 for s in "ab")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r["token_ids"] == library.encode_ordinary(text[r["doc_id"]]) and bytes(r["decoded"]).decode() == text[r["doc_id"]] and r["n_tokens"] == len(r["token_ids"])


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs(documents()[:40], clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    a = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert a == sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) and a


def through(spark, now, folder):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        out.append(now)
    return out


def test_empty_table(spark, docs, tmp_path):
    made = docs(documents()[:1], clashing=False).limit(0)
    got = through(spark, made, tmp_path)
    assert [x.count() for x in got] == [0] * 5 and all(x.columns == made.columns for x in got[:4])


def test_clashing_columns_nulls_and_repeats(spark, docs, tmp_path):
    rows = documents()[:60]
    odd = [(None, rows[3][1], "en", None), (None, rows[3][1], "en", None), (7, None, None, None), (8, "", "en", "a"), rows[5], rows[5], (500, "1 2 3", None, None), (501, rows[6][1], None, None)]
    df = docs([*rows, *odd])
    for name in ("__before", "lang_pred", "token_ids", "component_id", "kept", "whole", "rate", "boiler", "lines", "due"):
        df = df.withColumn(name, F.lit("mine"))
    language, lines, near, mixed, tokens = through(spark, df, tmp_path)
    assert all(x.columns == df.columns for x in (language, lines, near, mixed))
    assert {r["doc_id"] for r in language.collect()} == {i for i, t, *_ in [*rows, *odd] if t and any(c.isalpha() for c in t)}
    assert lines.count() == language.count() and lines.where("kept <> 'mine' or rate <> 'mine'").count() == 0
    kept = [r["doc_id"] for r in near.collect()]
    assert kept.count(5) == 1 and None in kept and 501 not in kept
    assert {r["doc_id"] for r in mixed.collect()} <= set(kept) and tokens.count() == mixed.count()
    assert mixed.where("text is null").count() == 0


def test_a_table_without_lengths(spark, docs, tmp_path):
    df = docs(documents()[:30], clashing=False).drop("n_chars")
    got = through(spark, df, tmp_path)
    assert got[1].columns == df.columns and got[4].count() > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
