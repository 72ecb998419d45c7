"""Byte-level BPE by prefix dynamic programming (operator 10).

For every byte prefix of a piece the one token that can end its valid encoding
is stored. Token ``t`` ends prefix ``i`` if ``t`` matches the bytes before ``i``
and the token stored for the prefix before ``t`` stays next to ``t`` when merges
run. Exactly one token satisfies this at each position, so the encoding of any
prefix is read off by walking back. Appending bytes leaves earlier entries as
they are; after an edit, entries are recomputed from the edit on until as many
consecutive entries as the longest token has bytes agree with the old ones.

Two neighbouring tokens stay apart unless, at some moment of merging, the
right edge ``a`` of the left one and the left edge ``b`` of the right one
coexist while joining them has a lower rank than what either does next.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import annotate

#: Pieces whose encodings a worker remembers, in two halves: when the newer half is full it becomes
#: the older one, so that what is met again and again stays.
PIECE_CACHE = 400_000
#: Longer pieces are not remembered.
PIECE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def unicode_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, as the tokenizer libraries do."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def narrow_pattern(pattern: str, below: int = 0x250) -> str | None:
    """The pattern for the standard library's ``re``, right for texts of code points under ``below``.

    Classes are written out; None if the pattern has others than letters, numbers and white space.
    """
    chars = [chr(c) for c in range(below)]
    listed = {
        r"\p{L}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N"),
        r"\s": "\\t-\\r \\x85\\xa0",
    }
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in listed if pattern.startswith(n, at)), None)
        if name:
            out.append(listed[name] if inside else f"[{listed[name]}]")
            at += len(name)
        elif pattern[at] == "\\":
            if pattern[at + 1] != "S" or inside:
                return None
            out.append(f"[^{listed[chr(92) + 's']}]")
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


class PrefixBpe:
    """Encoder and decoder for one vocabulary of byte tokens with merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.matcher = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.matcher.add_word(t.decode("latin-1"), (len(t), r))
        self.matcher.make_automaton()
        self._edges: dict[int, tuple | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def _children(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts merged last when the token's own bytes are merged; None if they don't become the token."""
        parts = [bytes([b]) for b in self.bytes_of[token]]
        while len(parts) > 2:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edges(self, token: int):
        """(left edge, right edge) of a token: the parts at that end, outermost first, each with
        the rank of the merge that consumes it; None for a token that merging never builds."""
        if token in self._edges:
            return self._edges[token]
        data = self.bytes_of[token]
        if len(data) == 1:
            found = (((data, None),), ((data, None),))
        elif (two := self._children(token)) is None:
            found = None
        else:
            left, right = self.edges(self.ranks[two[0]]), self.edges(self.ranks[two[1]])
            if left is None or right is None:
                found = None
            else:
                grow = lambda spine: tuple((p, token if n is None else n) for p, n in spine)
                found = (((data, None), *grow(left[0])), ((data, None), *grow(right[1])))
        self._edges[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes is just these two tokens."""
        key = (left, right)
        known = self._apart.get(key)
        if known is not None:
            return known
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        ok, ranks = self.edges(right) is not None, self.ranks
        for a, next_a in self.edges(left)[1] if ok else ():
            for b, next_b in self.edges(right)[0]:
                joined = ranks.get(a + b)
                # equal ranks are the same pair of bytes twice: the left one merges first
                if joined is not None and (next_a is None or joined < next_a) and (next_b is None or joined <= next_b):
                    ok = False
                    break
            if not ok:
                break
        self._apart[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Compute the last tokens of the prefixes of ``data`` that ``last`` doesn't have yet."""
        known, stop, done = self._apart.get, len(data) if stop is None else stop, len(last)
        begin = max(0, done - self.longest)
        # every token that ends at a place, place by place
        for at, (size, token) in self.matcher.iter(data[begin:stop].decode("latin-1")):
            end = begin + at + 1
            if end <= done:
                continue
            if end > size:
                before = last[end - size - 1]
                ok = known((before, token))
                if ok is None:
                    ok = self.apart(before, token)
            else:
                ok = self.edges(token) is not None
            if ok:
                last.append(token)
                done = end
        if done < stop:
            raise ValueError("the vocabulary lacks a single byte")

    def walk(self, last: Sequence[int], end: int | None = None) -> list[int]:
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of one piece. A piece that is itself a token is that token, as in the library."""
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """The encoding of one piece under appends and edits."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``end``; returns how many entries were recomputed."""
        shift, old = len(new) - (end - start), self.last
        self.data = self.data[:start] + new + self.data[end:]
        last, same, at = old[:start], 0, start
        while at < len(self.data):
            at += 1
            self.bpe.extend(self.data, last, at)
            before = at - shift
            agrees = before > end and old[before - 1] == last[-1]
            same = same + 1 if agrees else 0
            if same >= self.bpe.longest:  # later entries look back no further
                last += old[before:]
                break
        self.last = last
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class TextCodec:
    """Splits texts into pieces by a pattern and encodes each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = PrefixBpe(ranks)
        self.split = regex.compile(unicode_pattern(pattern)).findall
        narrow = narrow_pattern(pattern)
        self.split_narrow = re.compile(narrow).findall if narrow else self.split
        self.wide = re.compile("[^\x00-\u024f]").search
        self._pieces: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self.by_text = {str(r): (r, t) for t, r in ranks.items()}

    def pieces(self, text: str) -> list[str]:
        return self.split(text) if self.wide(text) else self.split_narrow(text)

    def ids_text(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        known, out = self._pieces, []
        for piece in self.pieces(text):
            got = known.get(piece)
            if got is None:
                got = self._older.get(piece)
                if got is None:
                    got = " ".join(map(str, self.bpe.encode_piece(piece.encode())))
                if len(piece) <= PIECE_BYTES:
                    if len(known) >= PIECE_CACHE // 2:
                        self._older = known
                        self._pieces = known = {}
                    known[piece] = got
            out.append(got)
        return " ".join(out)

    def both(self, ids_text: str) -> list[tuple[int, bytes]]:
        """(id, bytes) of each id in a text of them."""
        return list(map(self.by_text.__getitem__, ids_text.split()))

    def encode(self, text: str) -> list[int]:
        return [i for i, _ in self.both(self.ids_text(text))]

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.bpe.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    """One codec per worker, vocabulary file and pattern."""
    return TextCodec(load_ranks(path), pattern)


def bpe_encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), digests: bool = False
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``keep`` plus ``n_tokens``, ``token_ids`` and ``decoded`` (bytes),
    or with ``digests`` the SHA-256 of both in place of them. The vocabulary
    file at ``path`` must be readable on every executor. A null text is taken
    as empty and gives no tokens; a very long one is encoded whole, piece by
    piece; repeated rows give repeated results; an empty table gives an empty
    one; other columns are ignored.
    """

    def make():
        own = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(texts):
            rows = []
            for t in texts:
                text_ids = own.ids_text(t or "")
                both = own.both(text_ids)
                decoded = b"".join([x for _, x in both])
                if digests:
                    rows.append((len(both), sha(text_ids.encode()), sha(decoded)))
                else:
                    rows.append((len(both), [i for i, _ in both], decoded))
            return list(zip(*rows, strict=True))

        return run

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens bigint, token_ids array<int>, decoded binary"
    return annotate(df, [text], fields, make, keep)
