"""Texts of several megabytes, each on one line and on many, through all ten operators."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers as vocab
import pytest
import tiktoken

from strandline.llm import bpe, langid, licences, lines, mixing, neardup, quality, secrets, transport

SIZE = 3_000_000


@pytest.fixture(scope="module")
def texts():
    import random

    r = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    one = " ".join(r.choice(words) for _ in range(SIZE // 5))
    many = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(SIZE // 60))
    return [one, many, one[: len(one) // 2] + " token=abcdef12 the MIT license " + one[len(one) // 2 :], "", None]


@pytest.fixture()
def long_docs(docs, texts):
    return docs([(i, t, "en", "s") for i, t in enumerate(texts)])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_scans(long_docs, texts):
    found = by_id(secrets.scan_secrets(long_docs))
    assert found[2]["spans"].startswith("assign:") and found[0]["spans"] == found[3]["spans"] == ""
    got = by_id(licences.scan_licences(long_docs))
    assert got[2]["base_labels"] == "mit" and got[0]["n_words"] == len(texts[0].split()) and got[2]["first_word"] > 100_000


def test_line_dedup_and_mixing(long_docs, texts):
    got = by_id(lines.line_report(long_docs))
    assert got[1]["n_lines"] == texts[1].count("\n") + 1 and got[0]["text_md5"] == hashlib.md5(texts[0].encode()).hexdigest()
    mixed = by_id(mixing.mix(long_docs))
    assert mixed[0]["size"] == len(texts[0].split()) and mixed[4]["size"] == 0


def test_near_duplicates(long_docs):
    got = by_id(neardup.near_duplicates(long_docs, words=3, percent=85))
    assert [got[i]["component_id"] for i in range(5)] == [0, 1, 0, 3, 4] and got[0]["n_shingles"] > 500_000


def test_learnt_scores(spark, long_docs, docs, texts):
    model = langid.fit(long_docs, langid.learning_rows())
    got = by_id(langid.identify(long_docs, model))
    assert got[0]["lang_pred"] == "en" and got[4]["lang_pred"] == "und"
    field = quality.fit_rows([(*quality.own_features([t])[:2], y) for t, y in [("Good words here.\nAnd more.", 1), ("BAD!!|||", 0)] * 20])
    scores = by_id(quality.score_quality(long_docs, field))
    assert all(0 <= r["score"] <= 1 for r in scores.values())
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id bigint, quality int, toxic int")
    assert 0 <= by_id(quality.score_quality(long_docs, quality.fit(long_docs, labelled)))[1]["score"] <= 1


def test_media(long_docs, texts):
    got = by_id(transport.read_media(transport.store_media(long_docs)))
    raw = texts[0].encode()
    padded = raw + b" " * (-len(raw) % 192)
    assert got[0]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got[0]["tail_crc32"] == zlib.crc32(padded[-16:])


def test_byte_bpe(docs, texts):
    import base64

    some = texts[1][:1_000_000]
    path = vocab.path("byte_bpe_50k.tiktoken")
    got = bpe.bpe_encode(docs([(0, some, "en", "s"), (1, "a" * 200_000, "en", "s")]), path, vocab.PATTERN, digests=True)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = library.encode_ordinary(some)
    r = by_id(got)
    assert r[0]["n_tokens"] == len(ids) and r[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r[1]["decoded_sha256"] == hashlib.sha256(b"a" * 200_000).hexdigest()


def test_vectors_of_many_components(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from strandline.llm.neighbours import nearest_neighbours

    x = np.random.default_rng(1).normal(size=(40, 20_000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = [r["vec_id"] for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert got == [int(i) for i in np.argsort(d)[1:11]]
