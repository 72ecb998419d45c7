"""Secret scans (operator 3): fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import annotate

# The pattern kinds in their order, and the least length of what they find.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)  # 20 characters at least; a longest run, so the first try decides
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Character class: (its characters, window in characters, least entropy in bits a character).
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    "alnum": (frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.6),
    "base64": (frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 20, 3.8),
}
#: Candidates: longest runs of base64 characters, as long as a window.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
CANDIDATE_LEAST = 20
#: Longest runs of each class within a candidate.
RUNS = {"hex": re.compile(r"[0-9A-Fa-f]{20,}"), "alnum": re.compile(r"[0-9A-Za-z]{20,}"), "base64": re.compile(r"[A-Za-z0-9+/_=-]{20,}")}

#: Allowed candidates: identifiers that look random and are none, and placeholders.
ALLOWED = tuple(
    re.compile(p, re.I | re.A)
    for p in (
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
        r"[0-9+/_=-]*",  # digits: numbers, dates, phone and card numbers
        r".*(?:example|sample|placeholder|dummy|xxxx).*",
        r"(?:[a-z]+[_/-])+[a-z]*[0-9]{1,4}",  # words joined by a sign, with a number at the end
        r"(?-i:[_/-]*(?:(?=[a-z]{0,14}[aeiouy])[a-z]{1,15}[_/-]+)+(?:(?=[a-z]{0,14}[aeiouy])[a-z]{1,15})?)",  # lower-case words joined by signs
        r"[a-z]+[0-9]{1,4}",  # a word with a number
        r"(?=.*0123456789|.*abcdefghij).*",  # alphabets
    )
)


def _weights(n: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, n + 1)]


WEIGHTS = {window: _weights(window) for _, window, _ in CLASSES.values()}


def windows(s: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Spans covered by windows of ``s`` with an entropy of ``least`` bits a character or more.

    Counts change by one character in and one out, and with them the sum of
    c log2 c, from which the entropy is log2(window) - sum / window.
    """
    if len(s) < window:
        return
    weights, counts, total = WEIGHTS.get(window) or _weights(window), dict.fromkeys(s, 0), 0.0
    most = window * (math.log2(window) - least) + 1e-9
    begin = end = -1
    for i, c in enumerate(s):
        if i >= window:
            gone = s[i - window]
            n = counts[gone]
            total += weights[n - 1] - weights[n]
            counts[gone] = n - 1
        n = counts[c]
        total += weights[n + 1] - weights[n]
        counts[c] = n + 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if begin >= 0 and start <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = start, i + 1
    if begin >= 0:
        yield begin, end


def united(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy in candidates that aren't allowed; each class slides over its own runs."""
    out = []
    for found in CANDIDATE.finditer(text):
        begin, s = found.start(), found.group()
        pieces = [(m.start(), m.group()) for m in re.finditer(r"[^=]+=*", s)] if "=" in s else [(0, s)]
        for off, piece in pieces:
            if len(piece) < CANDIDATE_LEAST or any(p.fullmatch(piece) for p in ALLOWED):
                continue
            spans = []
            for name, (_, window, least) in CLASSES.items():
                for run in RUNS[name].finditer(piece):
                    if any(c.isalpha() for c in run.group()):  # digits alone are numbers
                        spans += [(run.start() + a, run.start() + b) for a, b in windows(run.group(), window, least)]
            out += [(begin + off + a, begin + off + b) for a, b in united(spans)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, each leftmost and without overlaps, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def listed(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(pattern spans, all spans). An entropy span that lies within a pattern span is that secret again and is left out."""
    text = text or ""
    base = base_spans(text)
    # the farthest end of the pattern spans that begin at or before a place
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    more = []
    for a, b in entropy_spans(text):
        at = bisect_right(starts, a)
        if not at or reach[at - 1] < b:
            more.append((a, 3, b))
    return base, sorted(base + more) if more else base


def scan_secrets(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus counts by kind, ``base_sha256`` and ``spans`` for every whole text.

    Offsets are code points, ends exclusive. A null or empty text has no
    spans; a very long one is scanned whole, in time that grows with its
    length; repeated rows give repeated results; an empty table gives an empty
    one; other columns are ignored.
    """

    def run(texts):
        rows = []
        for t in texts:
            base, every = scan(t)
            kinds = [k for _, k, _ in every]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        return list(zip(*rows, strict=True))

    fields = "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"
    return annotate(df, [text], fields, lambda: run, keep)
