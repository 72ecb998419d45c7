from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid
from strandline.llm.common import held_out
from strandline.llm.langid import FEATURES, UNDETERMINED, LanguageModel, counts, fit, ftrl, identify, keep_identified, learning_rows, temperature

from .conftest import ODD

WORDS = {"en": "the and of with that this which from other about", "de": "der und die mit dass dieser welche von andere über", "fr": "le et de avec que cette laquelle du autre à"}


def corpus(n=150):
    r = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang].split(), 12)), lang, "s"))
    return rows


def test_counts_against_plain_ngrams():
    text = "Abca bca é"
    grams = [text.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
    f, n = counts(text)
    assert n.sum() == len(grams) and len(f) <= len(set(grams)) and (np.diff(f) > 0).all() and f.max() < FEATURES
    assert len(counts("")[0]) == 0


def test_elastic_net_leaves_weights_out():
    rows = [(np.array([0, 1]), np.array([1.0, 0.001]), 0), (np.array([2, 1]), np.array([1.0, 0.001]), 1)] * 20
    w, _ = ftrl(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and w[2, 1] > 0 and not w[1].any() and not w[3:].any()


def test_temperature_cools_overconfidence():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 2000)
    z = np.where(np.arange(2)[None] == y[:, None], 1.0, 0.0) + r.normal(0, 1, (2000, 2))
    assert abs(temperature(z * 10, y) / temperature(z, y) - 10) < 0.1
    assert temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy_and_learning_only_from_the_rest(docs):
    rows = corpus()
    # labels of held-out rows are false: nothing may be learnt from them
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else la, s) for i, t, la, s in rows]
    df = docs(rows)
    model = fit(df, learning_rows())
    assert model.languages == ["de", "en", "fr"]
    got = identify(df, model).withColumn("held_out", held_out()).collect()
    assert len(got) == 150
    truth = {i: list(WORDS)[i % 3] for i in range(150)}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(docs):
    df = docs([*ODD, (7, "1234 !!", None, None), *[(100 + i, t, la, s) for i, t, la, s in corpus(60)]])
    model = fit(df, learning_rows())
    by_id = {r["doc_id"]: r for r in identify(df, model).collect()}
    for i in (None, 1, 2, 3, 7):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == (UNDETERMINED, 0.0)
    kept = keep_identified(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({None, 1, 2, 3, 7})
    assert kept.where("doc_id >= 100").count() == 60


def test_nothing_to_learn_from(docs):
    df = docs(ODD).withColumn("lang", F.lit(None).cast("string"))
    model = fit(df, learning_rows())
    assert model.languages == [] and {r["lang_pred"] for r in identify(df, model).collect()} == {UNDETERMINED}
    assert {r["doc_id"] for r in keep_identified(df, model).collect()} == {4, 5, 6}
    empty = df.limit(0)
    assert identify(empty, fit(empty, learning_rows())).count() == 0
    assert isinstance(model, LanguageModel)


def most_held(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_a_text_count_as_the_whole(monkeypatch, piece):
    # a capital sigma's small form depends on its neighbours, and \u0130 becomes two characters
    texts = ["ab" * 40 + "c", "\u039f\u03a3 \u03a3\u039f\u03a3 " * 30, "\u0130x\U0001f600" * 30, "abc", "a" * 129, "\ud800b" * 50]
    whole = [counts(t) for t in texts]
    monkeypatch.setattr(langid, "PIECE", piece)
    for t, (f, n) in zip(texts, whole, strict=True):
        got = counts(t)
        assert got[0].tolist() == f.tolist() and got[1].tolist() == n.tolist()
        assert got[0].dtype == f.dtype and got[1].dtype == n.dtype


def test_long_text_takes_little_beside_itself():
    text = "Word and another " * 250_000
    assert most_held(lambda: counts(text)) < 6 * len(text)


def test_batch_of_long_texts_is_sent_bit_by_bit():
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA5, 8000))) for _ in range(200)] + ["", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"l{i}" for i in range(202)]), pa.array(texts), pa.array([i % 3 == 0 for i in range(202)])], names=["label", "text", "calibrate"])
    assert most_held(lambda: [None for _ in langid.featurised([batch])]) < 30_000_000
    rows = pa.Table.from_batches(langid.featurised([batch, batch.slice(200)])).to_pylist()
    assert len(rows) == 204
    for i, row in zip([*range(202), 200, 201], rows, strict=True):
        f, n = counts(texts[i])
        assert row == {"label": f"l{i}", "calibrate": i % 3 == 0, "feature": f.tolist(), "n": n.tolist()}
