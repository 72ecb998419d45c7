from __future__ import annotations

import itertools
import zlib

import numpy as np

from strandline.llm import quality
from strandline.llm.common import held_out
from strandline.llm.quality import OWN, LineField, aggregate, fit, fit_curve, line_features, score_quality

from .conftest import ODD


def rows(n=240):
    r = np.random.default_rng(1)
    out, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        lines = []
        for _ in range(r.integers(1, 6)):
            w = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(8)]
            lines.append(" ".join(w) + "." if good else " | ".join(x.upper() + "!!" for x in w))
        out.append((i, "\n".join(lines), "en", "s"))
        labels.append((i, int(good), 0))
    return out, labels


def test_marginals_against_all_labellings():
    r = np.random.default_rng(2)
    for _ in range(20):
        per_text = np.array([3, 1, 5])
        e, t = r.normal(size=9), r.normal(size=(2, 2))
        field = LineField(np.zeros(1), np.ones(1), np.zeros(1), 0.0, t)
        got, at = field.marginals(e, per_text), 0
        for n in per_text:
            weight = np.zeros((2, n))
            for y in itertools.product((0, 1), repeat=int(n)):
                w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
                for k in range(n):
                    weight[y[k], k] += w
            assert np.allclose(got[at : at + n], weight[1] / weight.sum(axis=0))
            at += n


def test_long_chains_pass_in_pieces(monkeypatch):
    r = np.random.default_rng(3)
    per_text = np.array([1, 40, 7, 23, 8])
    e, t = r.normal(size=per_text.sum()) * 3, r.normal(size=(2, 2)) * 2
    whole = quality._messages(e, per_text, t)
    for piece in (1, 3, 8, 39):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert all(np.allclose(a, b) for a, b in zip(whole, quality._messages(e, per_text, t), strict=True))


def test_gradient_against_differences_of_the_enumerated_likelihood():
    r = np.random.default_rng(4)
    per_text = np.array([3, 1, 4])
    z, lines, theta = r.normal(size=(8, 3)), r.integers(0, 2, 8).astype(float), r.normal(size=8)
    weight = np.repeat(r.uniform(0.5, 2, 3), per_text)  # equal along a chain, so that the likelihood is a sum over chains
    pair = np.ones(8, bool)
    pair[np.cumsum(per_text) - 1] = False

    def score(theta, y, at, n):
        e, t = z @ theta[:3] + theta[3], theta[-4:].reshape(2, 2)
        return sum(e[at + k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:]))

    def likelihood(theta):
        total, at = 0.0, 0
        for n in per_text.tolist():
            every = [score(theta, y, at, n) for y in itertools.product((0, 1), repeat=n)]
            total += weight[at] * (score(theta, lines[at : at + n].astype(int).tolist(), at, n) - np.log(np.exp(every).sum()))
            at += n
        return total

    got = quality.gradient(theta, z, per_text, lines, weight, np.flatnonzero(pair))
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - got[i]) < 1e-5


def test_bad_lines_of_a_mixed_document_are_marked():
    texts, labels = rows(600)
    field = quality.fit_rows([(*quality.own_features([t])[:2], q) for (_, t, *_), (_, q, _) in zip(texts, labels, strict=True)])
    good = [x for _, t, *_ in texts[1::3] for x in t.split("\n")][:40]
    bad = [x for _, t, *_ in texts[0::3] for x in t.split("\n")][:6]
    body = [*good[:20], *bad[:3], *good[20:30], *bad[3:], *good[30:]]
    x, size, per_text = line_features(["\n".join(body)])
    p = field.marginals(field.emissions(x), per_text)
    is_bad = np.array([line in bad for line in body])
    assert (p[is_bad] < 0.5).all() and (p[~is_bad] > 0.5).all()
    whole, part = field.scores(["\n".join(good), "\n".join(body)])
    assert field.scores(["\n".join(bad)])[0] < part < whole


def test_every_line_of_a_learning_text_counts(spark, docs):
    texts, labels = rows(200)
    long = [(i, t if i else "\n".join([t] * 400), *x) for i, t, *x in texts]
    to = "doc_id bigint, quality int, toxic int"
    a, b = fit(docs(texts), spark.createDataFrame(labels, to)), fit(docs(long), spark.createDataFrame(labels, to))
    assert not np.array_equal(a.mean, b.mean)
    # beyond the bound on lines fewer documents are learnt from, each whole
    assert np.isfinite(fit(docs(long), spark.createDataFrame(labels, to), lines=300).weights).all()


def test_features_by_line_and_neighbours():
    x, size, per_text = line_features(["Ab1 cd.\n\nXY|!", "", "ab\nab"])
    assert per_text.tolist() == [3, 1, 2] and size.tolist() == [7, 0, 4, 0, 2, 2] and x.shape == (6, 3 * OWN)
    assert x[0, 0] == 1 / 4 and x[0, 11] == 1 and x[1, 13] == 1 and x[4:, 12].tolist() == [1, 1]
    assert (x[0, OWN : 2 * OWN] == 0).all() and (x[0, 2 * OWN :] == x[1, :OWN]).all() and (x[2, 2 * OWN :] == 0).all() and (x[3, OWN:] == 0).all()
    assert aggregate(np.array([1.0, 0.0, 0.5]), np.array([3, 0, 9]), np.array([2, 1])).tolist() == [0.8, 0.5]


def test_curve():
    a, b = fit_curve(np.array([0.2, 0.3, 0.7, 0.9] * 20), np.array([0, 0, 1, 1] * 20))
    assert a > 0 and abs(b) < 3


def test_held_out_accuracy_and_learning_only_from_the_rest(spark, docs):
    texts, labels = rows()
    # labels of held-out rows are turned round: nothing may be learnt from them
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, x) for i, q, x in labels]
    df = docs(texts)
    field = fit(df, spark.createDataFrame([*wrong, (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int"))
    got = score_quality(df, field).withColumn("held_out", held_out()).collect()
    truth = {i: q for i, q, _ in labels}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    again = fit(df, spark.createDataFrame(wrong, "doc_id bigint, quality int, toxic int"))
    assert np.array_equal(field.weights, again.weights)


def test_odd_rows(spark, docs):
    texts, labels = rows(60)
    df = docs([*ODD, *[(100 + i, *x) for i, *x in texts]])
    field = fit(df, spark.createDataFrame([(100 + i, q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in score_quality(df, field).collect()}
    assert got[1] == got[2] == got[None] and all(0 <= s <= 1 for s in got.values())
    none = fit(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r["score"] for r in score_quality(df, none).collect()} == {0.5}
    assert score_quality(df.limit(0), none).count() == 0
