"""Document quality by a linear-chain conditional random field over lines (operator 6).

Every line is good or bad. Its features come from its own characters and from
its neighbours'. Forward-backward gives each line's probability of being good;
the document's quality is their mean by line length, put through a logistic
curve fitted on labelled documents that the field was not fitted on.

A label speaks of a whole document, so chains of labelled documents alone
would teach that a label never changes. One in ``MIXED_SHARE`` learning
documents is therefore cut into runs of lines and laid together with one of
the other label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, held_out, small_batches

#: Most labelled documents that are fitted on, and most lines of them all; the documents are taken whole.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 200_000
#: One in so many documents of each label is laid together with one of the other, in runs of so many lines on average.
MIXED_SHARE = 4
RUN_LINES = 12
#: Lines of a chain that messages pass one after another; longer chains are passed in pieces abreast.
PIECE = 256
#: One in so many sampled documents serves the logistic curve instead.
CALIBRATION_SHARE = 4
#: Score from which a document is predicted good.
GOOD = 0.7
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20

_KINDS = ("lower", "upper", "digit", "space", "stop", "exclaim", "bar", "symbol", "wide", "control")


def _kind(b: int) -> int:
    c = chr(b)
    if 97 <= b <= 122:
        return 0
    if 65 <= b <= 90:
        return 1
    if 48 <= b <= 57:
        return 2
    if c in " \t\r\n\v\f":
        return 3
    if c in ".,;:?'\"-()":
        return 4
    if c == "!":
        return 5
    if c == "|":
        return 6
    if 33 <= b <= 126:
        return 7
    return 8 if b >= 128 else 9


_KIND_OF = np.array([_kind(b) for b in range(256)], np.uint8)
#: Features of a line by itself; with those of the line before and the one after, three times as many.
OWN = 14


def own_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line by itself, bytes of each line, lines of each text). A text without newline is one line, the empty one too."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    per_text = np.array([t.count("\n") + 1 for t in texts])
    kind = _KIND_OF[data]
    n = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(len(_KINDS))], axis=1).astype(float)
    n[:, 3] -= 1  # the newline
    gaps = kind == 3
    word_ends = np.flatnonzero(gaps[1:] & ~gaps[:-1]) + 1
    n_words = np.diff(np.searchsorted(word_ends, np.append(starts, len(data)), side="right"))
    inside = np.where(size > 0, ends - 1, ends)
    repeated = np.zeros(len(size))
    at = 0
    for t, k in zip(texts, per_text, strict=True):
        if k > 1:
            lines = t.split("\n")
            if len(set(lines)) < k:
                seen: dict[str, int] = {}
                for x in lines:
                    seen[x] = seen.get(x, 0) + 1
                repeated[at : at + k] = [seen[x] > 1 and x != "" for x in lines]
        at += k
    letters = n[:, 0] + n[:, 1] + n[:, 8]
    solid, w = np.maximum(size - n[:, 3], 1), np.maximum(n_words, 1)
    own = np.stack(
        [
            n[:, 1] / np.maximum(letters, 1),
            n[:, 2] / solid,
            n[:, 4] / w,
            np.minimum(n[:, 5] / w, 2),
            np.minimum(n[:, 6] / w, 2),
            np.minimum(n[:, 7] / w, 4),
            n[:, 8] / solid,
            n[:, 9] / solid,
            np.minimum(solid / w, 40) / 10,
            np.log1p(size) / 5,
            (n_words <= 3).astype(float),
            (_KIND_OF[data[inside]] == 4).astype(float),
            repeated,
            (size == 0).astype(float),
        ],
        axis=1,
    )
    return own, size, per_text


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Features with those of the line before and the one after; none beyond a text's ends."""
    first = np.zeros(len(own), bool)
    first[np.cumsum(per_text)[:-1]] = True
    first[0] = True
    last = np.append(first[1:], True)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after])


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines of each text)."""
    own, size, per_text = own_features(texts)
    return with_neighbours(own, per_text), size, per_text


@dataclass
class LineField:
    """A two-state chain: emission weights for good against bad, and transition scores [from, to]."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def marginals(self, e: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        forward, backward = _messages(e, per_text, self.transitions)
        return _sigmoid(forward + backward)

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        """Quality of whole texts, in chunks of bounded size."""
        out: list[float] = []
        chunk: list[str] = []
        held = 0
        for t in texts:
            chunk.append(t or "")
            held += len(chunk[-1])
            if held >= CHUNK_BYTES:
                out += self._scores(chunk)
                chunk, held = [], 0
        return out + (self._scores(chunk) if chunk else [])

    def _scores(self, texts: list[str]) -> list[float]:
        x, size, per_text = line_features(texts)
        raw = aggregate(self.marginals(self.emissions(x), per_text), size, per_text)
        return _sigmoid(self.slope * _logit(raw) + self.offset).tolist()


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def aggregate(marginals: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Means by line length; a line counts its newline, so empty texts have a mean too."""
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    w = size + 1.0
    return np.add.reduceat(marginals * w, starts) / np.add.reduceat(w, starts)


def _passed(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Forward log-odds of chains that begin with log-odds ``enter`` before their first line's emission, all chains abreast."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, r = starts[order], lengths[order], enter[order]
    out = np.empty_like(e)
    active = len(lengths)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[active - 1] <= i:
            active -= 1
        at = starts[:active] + i
        r = e[at] + r[:active]
        out[at] = r
        r = np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])
    return out


def _forward(e: np.ndarray, per_text: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the forward messages, own emission included.

    A chain of more than ``PIECE`` lines is passed in pieces. What a piece does
    to the log-odds that enter it is a matrix of two by two, found for all
    pieces abreast; the matrices are then applied one after another.
    """
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    pieces = -(-per_text // PIECE)
    if int(pieces.max(initial=0)) <= 1:
        return _passed(e, starts, per_text, t, np.zeros(len(starts)))
    of = np.repeat(np.arange(len(per_text)), pieces)
    k = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
    begin = starts[of] + k * PIECE
    size = np.minimum(PIECE, per_text[of] - k * PIECE)
    # whole pieces only: [entering state, state that enters the next piece], scaled to a maximum of 0
    m = np.zeros((2, 2, len(of)))
    m[0, 1] = m[1, 0] = -np.inf
    whole = np.flatnonzero(size == PIECE)
    x = m[:, :, whole]
    for i in range(PIECE):
        x = x + np.stack([np.zeros(len(whole)), e[begin[whole] + i]])[None]
        x = np.stack([np.logaddexp(x[:, 0] + t[0, 0], x[:, 1] + t[1, 0]), np.logaddexp(x[:, 0] + t[0, 1], x[:, 1] + t[1, 1])], axis=1)
        x -= x.max(axis=(0, 1), keepdims=True)
    m[:, :, whole] = x
    enter = np.zeros(len(of))
    for step in range(1, int(pieces.max())):
        now = np.flatnonzero(k == step)
        r, p = enter[now - 1], m[:, :, now - 1]
        enter[now] = np.logaddexp(r + p[1, 1], p[0, 1]) - np.logaddexp(r + p[1, 0], p[0, 0])
    return _passed(e, begin, size, t, enter)


def _messages(e: np.ndarray, per_text: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward messages (own emission included) and of the backward ones (excluded)."""
    # backward is forward from the other end, with transitions the other way
    behind = _forward(e[::-1], per_text[::-1], t.T)[::-1]
    return _forward(e, per_text, t), behind - e


def laid_together(own: np.ndarray, per_text: np.ndarray, y: np.ndarray, run: int = RUN_LINES, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, lines of each chain, label of each line, weight of each line) to learn from.

    One in ``MIXED_SHARE`` documents is cut into runs of some ``run`` lines, and
    those of a good and a bad one alternate in a chain, as long as there are
    both. Every other document is a chain by itself. A document counts once however many lines it
    has, and classes weigh the same in sum.
    """
    draw = np.random.default_rng(seed)
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y) / per_text
    mixed = {c: [i for i in np.flatnonzero(y == c).tolist() if i % MIXED_SHARE == 1] for c in (0, 1)}
    pairs = list(zip(mixed[0], mixed[1]))  # noqa: B905
    used = {i for p in pairs for i in p}
    chains = [[(i, 0, int(per_text[i]))] for i in range(len(y)) if i not in used]
    for p in pairs:
        left, turn, chain = {i: 0 for i in p}, int(draw.integers(2)), []
        while left:
            i = p[turn] if p[turn] in left else next(iter(left))
            at = left[i]
            end = min(int(per_text[i]), at + int(draw.geometric(1 / run)))
            chain.append((i, at, end))
            left[i] = end
            if end == per_text[i]:
                del left[i]
            turn = 1 - turn
        chains.append(chain)
    take = np.concatenate([np.arange(starts[i] + a, starts[i] + b) for c in chains for i, a, b in c])
    lengths = np.array([sum(b - a for _, a, b in c) for c in chains])
    labels, weights = np.repeat(y, per_text).astype(float), np.repeat(weight, per_text)
    return with_neighbours(own[take], lengths), lengths, labels[take], weights[take]


def fit_field(x: np.ndarray, per_text: np.ndarray, lines: np.ndarray, line_weight: np.ndarray, l2: float = 1e-3, steps: int = 150, rate: float = 0.1) -> LineField:
    """Maximum likelihood of the lines' labels along chains, by Adam."""
    theta = np.zeros(x.shape[1] + 5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    pair = np.ones(len(lines), bool)
    pair[np.cumsum(per_text) - 1] = False
    left = np.flatnonzero(pair)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = gradient(theta, z, per_text, lines, line_weight, left) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2).copy())


def gradient(theta: np.ndarray, z: np.ndarray, per_text: np.ndarray, lines: np.ndarray, line_weight: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Expected less given features: of emissions (weights, bias) and of transitions (from each of ``left`` to the line after it)."""
    w, bias, t = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
    e = z @ w + bias
    forward, backward = _messages(e, per_text, t)
    miss = (lines - _sigmoid(forward + backward)) * line_weight
    r, after = forward[left], (e + backward)[left + 1]
    four = np.stack([np.full(len(left), t[0, 0]), t[0, 1] + after, t[1, 0] + r, t[1, 1] + r + after])
    four = np.exp(four - four.max(axis=0, initial=-np.inf)) if len(left) else four
    four = four / four.sum(axis=0) if len(left) else four
    seen = np.zeros((4, len(left)))
    seen[(2 * lines[left] + lines[left + 1]).astype(int), np.arange(len(left))] = 1
    return np.concatenate([z.T @ miss, [miss.sum()], ((seen - four) * line_weight[left]).sum(axis=1)])


def fit_curve(raw: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic curve over log-odds, by Newton steps with targets kept off 0 and 1."""
    x = np.stack([_logit(raw), np.ones(len(raw))])
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(theta @ x)
        g = x @ (p - target) / len(raw) + l2 * (theta - [1.0, 0.0]) * [1, 0.01]
        h = (x * (p * (1 - p))) @ x.T / len(raw) + np.diag([l2, l2 * 0.01]) + 1e-9 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(theta[0]), float(theta[1])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES
) -> LineField:
    """Fit on at most twice ``documents`` labelled rows that are not held out, of at most ``lines`` lines in all.

    Rows are taken, with their whole texts, where a hash of the key falls under
    ``documents`` / labelled rows, and in the hash's order as long as their
    lines together are within ``lines``; being so few, their labels are
    broadcast. Null labels, keys and texts are not learnt from, texts of more
    than ``lines`` lines neither. With no rows, or rows of one class, every
    document scores 0.5.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(
        F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out("key")
    )
    share = min(1.0, documents / max(1, usable.count()))
    hashed = F.pmod(F.xxhash64(F.lit("quality"), F.col("key").cast("string")), F.lit(2**31))
    sample = usable.where(hashed < F.lit(share * 2**31)).limit(2 * documents)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(sample), "key")
    rows = rows.select(F.xxhash64(F.lit("place"), F.col("key").cast("string")).alias("draw"), "y", "text", F.size(F.split("text", "\n")).alias("n"))
    # which of them: a few thousand numbers, in the hash's order
    chosen, held = None, 0
    for r in sorted(rows.select("draw", "n").limit(2 * documents).collect()):
        held += r["n"]
        if held > lines:
            break
        chosen = r["draw"]
    rows = rows.where((F.col("draw") <= chosen) if chosen is not None else F.lit(False)).drop("n")

    def featurise(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for draw, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, size, _ = own_features([t])
                out.append((draw, y, x.astype(np.float32).tobytes(), size.astype(np.int64).tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["draw", "y", "x", "size"])

    got = rows.mapInArrow(featurise, "draw bigint, y int, x binary, size binary").limit(2 * documents).toArrow().to_pylist()
    got.sort(key=lambda r: (r["draw"], r["y"], r["x"]))  # the order rows arrive in doesn't matter
    return fit_rows([(np.frombuffer(r["x"], np.float32).reshape(-1, OWN).astype(float), np.frombuffer(r["size"], np.int64), r["y"]) for r in got])


def fit_rows(rows: Sequence[tuple[np.ndarray, np.ndarray, int]]) -> LineField:
    """Fit on documents given as (own features, bytes of each line, label); one in ``CALIBRATION_SHARE`` serves the curve."""
    parts: dict[bool, list] = {False: [], True: []}
    for i, r in enumerate(rows):
        parts[i % CALIBRATION_SHARE == 0].append(r)
    if len({y for _, _, y in parts[False]}) < 2:
        flat = np.zeros(3 * OWN)
        return LineField(flat, flat + 1, flat, 0.0, np.zeros((2, 2)))

    def joined(part):
        return np.concatenate([x for x, _, _ in part]), np.concatenate([s for _, s, _ in part]), np.array([len(s) for _, s, _ in part]), np.array([y for _, _, y in part])

    own, _, per_text, y = joined(parts[False])
    field = fit_field(*laid_together(own, per_text, y))
    if parts[True]:
        own, size, per_text, y = joined(parts[True])
        raw = aggregate(field.marginals(field.emissions(with_neighbours(own, per_text)), per_text), size, per_text)
        field.slope, field.offset = fit_curve(raw, y)
    return field


def score_quality(df: DataFrame, field: LineField, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.7) for every whole text.

    A null text is scored as the empty one, a single empty line. Very long
    texts are scored whole, their lines in pieces abreast. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are
    ignored.
    """

    def make():
        def run(texts):
            s = field.scores(texts)
            return s, [int(p >= GOOD) for p in s]

        return run

    return annotate(df, [text], "score double, predicted int", make, keep)
