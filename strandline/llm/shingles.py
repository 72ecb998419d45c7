"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Words of more bytes are hashed by a digest: a polynomial modulo 2^64 tells words apart that nobody built to defeat it,
#: and such words are long.
LONG_WORD = 256
#: Bytes of text hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> _SHIFT)) * _MIX[0]
    h = (h ^ (h >> _SHIFT)) * _MIX[1]
    return h ^ (h >> _SHIFT)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            more, less = np.uint64(pow(_BASE, k, 1 << 64)), np.uint64(pow(_INVERSE, k, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * more]), np.concatenate([self.down, self.down * less])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts in order, the words of each text). Words are runs without ASCII white space."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    # every word's bytes as a polynomial, taken from running sums and shifted back to power 0
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    words = mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[2])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        words[i] = np.frombuffer(digest, np.uint64)[0]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, limits, side="left"), prepend=0)


def shingle_sets(texts: Sequence[str | None], words: int) -> Iterator[np.ndarray]:
    """For each whole text its sorted distinct shingles of ``words`` words, A-Z lowered.

    A text with fewer words gives its whole sequence as one shingle; a null
    text or one without words gives none.
    """
    chunk: list[bytes] = []
    held = 0
    for t in texts:
        chunk.append((t or "").encode().lower())
        held += len(chunk[-1])
        if held >= CHUNK_BYTES:
            yield from _sets(chunk, words)
            chunk, held = [], 0
    if chunk:
        yield from _sets(chunk, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    w, counts = word_hashes(texts)
    at = 0
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for k in range(words):
            h = (h ^ (h >> _SHIFT)) * _MIX[3] + w[k : len(w) - words + 1 + k]
        h = mix(h)
    for n in counts.tolist():
        if n >= words:
            yield np.unique(h[at : at + n - words + 1])
        elif n:
            short = np.array([n], np.uint64)
            for k in range(at, at + n):
                short = mix(short * _MIX[2] + w[k : k + 1])
            yield short
        else:
            yield np.empty(0, np.uint64)
        at += n
