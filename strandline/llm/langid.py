"""Language identification (operator 1).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a
temperature. Document frequencies are counted over all learning rows; weights
are fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, hand_back, held_out, small_batches

#: n-gram lengths; n-grams are hashed into this many features.
ORDERS = (1, 2, 3)
FEATURES = 1 << 16
#: Most learning rows for each language that weights are fitted on.
SAMPLE_PER_LANGUAGE = 700
#: One in so many sampled rows serves calibration instead.
CALIBRATION_SHARE = 5
#: Characters whose n-grams are counted at once, some 40 bytes each.
PIECE = 1 << 18
#: Features of sampled rows after which a worker sends what it holds.
SEND_FEATURES = 1 << 18
UNDETERMINED = "und"
#: Documents whose calibrated score is lower are rejected by :func:`keep_identified`.
LEAST_SCORE = 0.5


def _letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _piece_counts(piece: str, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, occurrences) of the n-grams that end behind the first ``before`` characters."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        with np.errstate(over="ignore"):
            h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        if n in ORDERS:
            own = h[max(0, before - n + 1) :]
            parts.append(((own + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16)).astype(np.uint16))
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    keys = np.sort(np.concatenate(parts), kind="stable")  # radix sort: linear in the text
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], edge))
    return keys[starts].astype(np.int64), np.diff(np.append(starts, len(keys))).astype(float)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, occurrences) of the whole text's character n-grams, lower-cased.

    A long text is counted a piece at a time; beside it there is only its
    lower-cased form, which depends on what stands around a letter.
    """
    low = text.lower()
    if len(low) <= PIECE:
        return _piece_counts(low, 0)
    total = np.zeros(FEATURES)
    for at in range(0, len(low), PIECE):
        before = min(at, max(ORDERS) - 1)
        f, n = _piece_counts(low[at - before : at + PIECE], before)
        total[f] += n
    f = np.flatnonzero(total)
    return f, total[f]


@dataclass
class LanguageModel:
    """Weights for each feature and language, with the idf and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(features, values): (1 + ln tf) idf, scaled to length 1."""
        f, n = counts(text)
        v = (1 + np.log(n)) * self.idf[f]
        norm = np.sqrt(v @ v)
        return f, v / norm if norm else v

    def logits(self, text: str) -> np.ndarray:
        f, v = self.vector(text)
        return v @ self.weights[f] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); undetermined with 0 for a null text or one without letters, or if no language was learnt."""
        if text is None or not self.languages or not _letters(text):
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(
    rows: Sequence[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    epochs: int = 3,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression by per-coordinate FTRL-proximal steps.

    A coordinate's weight is 0 while its gradient sum is within ``l1``, else it
    is pulled back by ``l1`` and shrunk by ``l2`` and its learning rate.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def solve(f):
        w = -(z[f] - np.sign(z[f]) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
        return np.where(np.abs(z[f]) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, v, y = rows[i]
            f, v = np.append(f, FEATURES), np.append(v, 1.0)
            w = solve(f)
            p = _softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = solve(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def temperature(logits: np.ndarray, y: np.ndarray, steps: int = 60) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        top = s.max(axis=1)
        return float(np.mean(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]))

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _corpus_counts(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """In how many rows each feature occurs, and the rows of each label, by one pass; each task sends one vector of sums."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        df, labels = np.zeros(FEATURES, np.int64), Counter()
        for b in batches:
            labels.update(b.column(1).to_pylist())
            for t in b.column(0).to_pylist():
                df[counts(t)[0]] += 1
        hand_back()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at.tolist(), *[None] * len(labels)], pa.int64()), pa.array([*[None] * len(at), *labels], pa.string()), pa.array([*df[at].tolist(), *labels.values()], pa.int64())],
            names=["feature", "label", "n"],
        )

    # not grouped by text or document: what is shuffled is bounded by tasks x (features + labels)
    found = rows.select("text", "label").mapInArrow(run, "feature bigint, label string, n bigint").groupBy("feature", "label").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    out = np.zeros(FEATURES, np.int64)
    for r in found:
        if r["feature"] is not None:
            out[r["feature"]] = r["n"]
    return out, {r["label"]: r["n"] for r in found if r["feature"] is None}


def featurised(batches) -> Iterator:
    """Rows of (label, text, calibrate) with the text's features and occurrences in its place.

    What has been counted is sent after ``SEND_FEATURES`` features, however many rows a batch has.
    """
    import pyarrow as pa

    for b in batches:
        first, got, held = 0, [], 0
        for i, t in enumerate(b.column(1), 1):
            f, n = counts(t.as_py())
            got.append((f.astype(np.int32), n.astype(np.float32)))
            held += len(f)
            if held >= SEND_FEATURES or i == b.num_rows:
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in got)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in got]))) for k in range(2)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:i], b.column(2)[first:i], *lists], names=["label", "calibrate", "feature", "n"])
                first, got, held = i, [], 0
    hand_back()


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` for which ``learn`` holds, with a text and a label.

    ``per_language`` bounds the sample: rows are taken where a hash of the key
    falls under bound / rows of that language, and no more than twice the bound
    is kept. Without learning rows the model predicts nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")
    )
    df, sizes = _corpus_counts(rows)
    languages, total = sorted(sizes), sum(sizes.values())
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))
    idf = np.log((1 + total) / (1 + df)) + 1

    limits = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n) * 2**31))])
    share = F.pmod(F.xxhash64(F.lit("langid"), "key"), F.lit(2**31))
    sample = rows.where(share < limits[F.col("label")]).select(
        "label", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "key"), F.lit(CALIBRATION_SHARE)) == 0).alias("calibrate")
    )

    sent = sample.mapInArrow(featurised, "label string, calibrate boolean, feature array<int>, n array<float>")
    model = LanguageModel(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    fitted, held, taken = [], [], dict.fromkeys(languages, 0)
    for r in sent.limit(2 * per_language * len(languages)).toArrow().to_pylist():
        y = languages.index(r["label"])
        f, n = np.array(r["feature"], np.int64), np.array(r["n"], float)
        taken[r["label"]] += 1
        if taken[r["label"]] > 2 * per_language or not len(f):
            continue
        v = (1 + np.log(n)) * idf[f]
        (held if r["calibrate"] else fitted).append((f, v / np.sqrt(v @ v), y))
    fitted = fitted or held
    fitted.sort(key=lambda r: (len(r[0]), r[2], r[1].sum()))  # the order rows arrive in doesn't matter
    if fitted:
        model.weights, model.bias = ftrl(fitted, len(languages))
    if held:
        logits = np.array([v @ model.weights[f] + model.bias for f, v, _ in held])
        model.temperature = temperature(logits, np.array([y for _, _, y in held]))
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score`` (the calibrated probability) for every whole text.

    A null text or one without letters, as the empty one, is ``und`` with score
    0; a very long one is counted whole. Ties go to the first language by name;
    repeated rows give repeated results; an empty table gives an empty one;
    other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(_compact(model))

    def make():
        own = _expand(shared.value)

        def run(texts):
            got = [own.predict(t) for t in texts]
            return [x for x, _ in got], [p for _, p in got]

        return run

    return annotate(df, [text], "lang_pred string, score double", make, keep)


def _compact(m: LanguageModel):
    """Bounded by features x languages; single precision, the idf included."""
    return m.languages, m.idf.astype(np.float32), m.weights.astype(np.float32), m.bias, m.temperature


def _expand(x) -> LanguageModel:
    languages, idf, weights, bias, t = x
    return LanguageModel(languages, idf.astype(float), weights.astype(float), bias, t)


def keep_identified(df: DataFrame, model: LanguageModel, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df`` whose language is determined with a score of ``least`` or more; all columns as they were.

    If nothing could be learnt, only rows without letters go.
    """
    shared = df.sparkSession.sparkContext.broadcast(_compact(model))

    def make():
        own = _expand(shared.value)

        def run(texts):
            return ([bool(t is not None and _letters(t) and (not own.languages or own.predict(t)[1] >= least)) for t in texts],)

        return run

    flag = "__kept"
    while flag in df.columns:
        flag += "_"
    return annotate(df, [text], f"`{flag}` boolean", make, df.columns).where(F.col(flag)).drop(flag)


def learning_rows(key: str = "doc_id") -> Column:
    """Rows that may be learnt from: those that aren't held out. A row without an id is not learnt from."""
    return F.col(key).isNotNull() & ~held_out(key)
