"""Operators without SQL against plain versions that share no code with them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from strandline.llm import langid
from strandline.llm.langid import FEATURES, counts, fit, ftrl, learning_rows
from strandline.llm.secrets import scan
from strandline.llm.transport import demux, mux, read_media, store_media

# Operator 1


def plain_features(text):
    """Hashed n-grams, one after another."""
    out = Counter()
    t = text.lower()
    for i in range(len(t)):
        h = 0
        for n in range(1, 4):
            if i + n > len(t):
                break
            h = (h + ord(t[i + n - 1])) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            out[((h + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 16] += 1
    return out


def test_features_one_by_one():
    for text in ("", "a", "ab", "Straße 漢字 😀", "the quick brown fox " * 20):
        f, n = counts(text)
        assert dict(zip(f.tolist(), n.tolist(), strict=True)) == plain_features(text)


def test_tf_idf_vectors(docs):
    rows = [(i, t, la, "s") for i, (t, la) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("die maus", "de"), ("a mouse", "en"), ("der und", "de"), ("and of", "en"), ("zu", "de"), ("to", "en")] * 4)]
    model = fit(docs(rows), learning_rows())
    learnt = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(f for t in learnt for f in plain_features(t))
    text = "the dog und die"
    want = {f: (1 + math.log(n)) * (math.log((1 + len(learnt)) / (1 + df[f])) + 1) for f, n in plain_features(text).items()}
    norm = math.sqrt(sum(v * v for v in want.values()))
    f, v = model.vector(text)
    assert f.tolist() == sorted(want) and np.allclose(v, [want[k] / norm for k in sorted(want)])


def plain_ftrl(rows, classes, alpha, beta, l1, l2, order):
    """FTRL-proximal a coordinate at a time, as published."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for i in order:
        f, v, y = rows[i]
        x = [*zip(f.tolist(), v.tolist(), strict=True), (FEATURES, 1.0)]
        w = {(a, c): weight((a, c)) for a, _ in x for c in range(classes)}
        s = [sum(w[a, c] * b for a, b in x) for c in range(classes)]
        top = max(s)
        e = [math.exp(t - top) for t in s]
        for a, b in x:
            for c in range(classes):
                g = b * (e[c] / sum(e) - (c == y))
                k = (a, c)
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return weight


def test_ftrl_steps():
    r = np.random.default_rng(3)
    rows = []
    for i in range(30):
        f = np.sort(r.choice(40, 6, replace=False))
        v = r.uniform(0.1, 1, 6)
        rows.append((f, v / np.sqrt(v @ v), i % 3))
    w, bias = ftrl(rows, 3, alpha=0.7, beta=1.0, l1=0.05, l2=0.1, epochs=2, seed=5)
    draw = np.random.default_rng(5)
    order = [i for _ in range(2) for i in draw.permutation(len(rows)).tolist()]
    want = plain_ftrl(rows, 3, 0.7, 1.0, 0.05, 0.1, order)
    assert np.allclose([[want((a, c)) for c in range(3)] for a in range(40)], w[:40], atol=1e-12) and np.allclose([want((FEATURES, c)) for c in range(3)], bias, atol=1e-12)
    assert (w[:40] == 0).any() and not w[40:].any()


def test_one_pass_counts_labels_and_features(docs):
    rows = [(i, f"text {i % 7} abc", ["de", "en", None][i % 3], "s") for i in range(90)]
    df = docs(rows)
    got, sizes = langid._corpus_counts(df.where("lang is not null").selectExpr("text", "lang as label"))
    assert sizes == {"de": 30, "en": 30}
    want = Counter(f for _, t, la, _ in rows if la for f in plain_features(t))
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want


# Operator 3


CHARACTERS = {
    "hex": (set("0123456789abcdefABCDEF"), 20, 3.0),
    "alnum": ({c for c in map(chr, range(128)) if c.isalnum()}, 20, 3.6),
    "base64": ({c for c in map(chr, range(128)) if c.isalnum()} | set("+/_=-"), 20, 3.8),
}
WORDY = [
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"), re.compile(r"[0-9+/_=-]*"), re.compile(r"[A-Za-z]+[0-9]{1,4}"),
    re.compile(r"(?:[A-Za-z]+[_/-])+[A-Za-z]*[0-9]{1,4}"),
]


def plain_entropy(text):
    """Places under a window of enough entropy, candidate by candidate, window by window."""
    held = set()
    base64 = CHARACTERS["base64"][0]
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in base64:
            j += 1
        pieces, at = [], i
        for k in range(i, j):
            # a sign of equality ends a piece, but for those that pad it
            if text[k] != "=" and k > i and text[k - 1] == "=" and any(c != "=" for c in text[at:k]):
                pieces.append((at, k))
                at = k
        if j > i:
            pieces.append((at, j))
        for a, b in pieces:
            while a < b and text[a] == "=" and len(pieces) > 0 and "=" in text[i:j]:
                a += 1
            s, low = text[a:b], text[a:b].lower()
            allowed = any(p.fullmatch(s) for p in WORDY) or any(w in low for w in ("example", "sample", "placeholder", "dummy", "xxxx", "0123456789", "abcdefghij"))
            parts = [p for p in re.split(r"[_/-]+", s) if p]
            wordy = re.search(r"[_/-]", s) and all(re.fullmatch(r"[a-z]{1,15}", p) and re.search("[aeiouy]", p) for p in parts) and re.match(r"[_/-]*[a-z]", s)
            if len(s) < 20 or j - i < 20 or allowed or wordy:
                continue
            for kinds, window, least in CHARACTERS.values():
                k = a
                while k < b:
                    e = k
                    while e < b and text[e] in kinds:
                        e += 1
                    if any(c.isalpha() for c in text[k:e]):
                        for w in range(k, e - window + 1):
                            c = Counter(text[w : w + window])
                            if -sum(n / window * math.log2(n / window) for n in c.values()) >= least - 1e-10:
                                held |= set(range(w, w + window))
                    k = max(e, k + 1)
        i = max(j, i + 1)
    return held


def test_candidates_classes_and_allowed_ones():
    r = random.Random(4)
    alphabet = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-"
    words = ["the", "config", "value", "of", "rhythm", "sample", "x"]
    for _ in range(1500):
        parts = []
        for _ in range(r.randrange(1, 5)):
            kind = r.randrange(6)
            if kind == 0:
                parts.append("".join(r.choice(alphabet) for _ in range(r.randrange(10, 45))))
            elif kind == 1:
                parts.append("".join(r.choice("0123456789abcdef") for _ in range(r.randrange(15, 23))))
            elif kind == 2:
                parts.append("_".join(r.choice(words) for _ in range(r.randrange(2, 9))))
            elif kind == 3:
                parts.append("-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)))
            elif kind == 4:
                parts.append("".join(r.choice("ab") for _ in range(30)))
            else:
                parts.append("".join(r.choice("0123456789") for _ in range(25)))
        text = r.choice([" ", ", ", "é"]).join(parts)
        base, every = scan(text)
        covered = set()
        for a, k, b in every:
            if k == 3:
                covered |= set(range(a, b))
        want = plain_entropy(text)
        for a, _, b in base:  # a run within a pattern's span is that secret again
            inside = set(range(a, b))
            runs = [set()]
            for p in sorted(want):
                if runs[-1] and p - 1 not in runs[-1]:
                    runs.append(set())
                runs[-1].add(p)
            want = set().union(*(x for x in runs if not x <= inside))
        assert covered == want, text


def test_many_spans_take_linear_time():
    import time

    r = random.Random(5)
    unit = lambda: "token=" + "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)) + " "
    text = "".join(unit() for _ in range(3000))
    begun = time.perf_counter()
    scan(text)
    small = time.perf_counter() - begun
    begun = time.perf_counter()
    base, every = scan(text * 8)
    assert len(base) == 24_000 == len(every)
    assert time.perf_counter() - begun < 8 * small * 3 + 1


# Operator 9


def plain_read(stream):
    """Payload and what else stands in a transport stream of one program, bit by bit by the standard's tables."""
    bits = lambda data, at, n: int("".join(f"{b:08b}" for b in data[at // 8 : (at + n + 7) // 8])[at % 8 : at % 8 + n], 2)
    counters, maps, carried, pes, stamps, points = {}, {}, {}, [], [], []
    assert len(stream) % 188 == 0
    for k in range(0, len(stream), 188):
        p = stream[k : k + 188]
        assert bits(p, 0, 8) == 0x47 and bits(p, 8, 1) == 0
        start, pid, control, counter = bits(p, 9, 1), bits(p, 11, 13), bits(p, 26, 2), bits(p, 28, 4)
        assert control in (1, 3) and counter == (counters.get(pid, counter - 1 & 15) + 1) & 15
        counters[pid] = counter
        body = p[4:]
        access = False
        if control == 3:
            access = bool(body[0] and body[1] & 0x40)
            if body[0] and body[1] & 0x10:  # a clock reference stands there
                clock = bits(body, 16, 33)
                assert access and clock == len(points) * 8 * 3600
            body = body[1 + body[0] :]
        if pid == 0 or pid in maps.values():
            section = body[1 + body[0] :]
            size = 3 + bits(section, 12, 12)
            section = section[:size]
            crc = 0xFFFFFFFF
            for b in section:
                for i in range(7, -1, -1):
                    crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31) ^ (b >> i & 1) else 0)) & 0xFFFFFFFF
            assert crc == 0
            if pid == 0:
                assert section[0] == 0
                maps = {bits(section, 64, 16): bits(section, 83, 13)}
            else:
                assert section[0] == 2
                at = 12 + bits(section, 84, 12)
                carried = {bits(section, at * 8 + 11, 13): section[at]}
        elif pid in carried:
            if start:
                assert body[:3] == b"\0\0\1"
                pes.append(bytearray())
                points += [len(pes) - 1] if access else []
                size = int.from_bytes(body[4:6], "big")
                flags = body[7]
                if flags & 0x80:
                    t = bits(body, 9 * 8 + 4, 3) << 30 | bits(body, 10 * 8, 15) << 15 | bits(body, 12 * 8, 15)
                    assert bits(body, 9 * 8, 4) == 2 and body[9] & 1 and body[11] & 1 and body[13] & 1
                    stamps.append(t)
                expected = size - 3 - body[8]
                pes[-1] += body[9 + body[8] :]
                sizes = (expected,)
            else:
                pes[-1] += body
            assert len(pes[-1]) <= max(sizes[0], len(pes[-1]))
    return b"".join(bytes(x) for x in pes), stamps, points


def test_streams_by_an_independent_reader(docs):
    r = random.Random(6)
    for n in (192, 3072, 3073, 9600, 192 * 300):
        payload = r.randbytes(n)
        got, stamps, points = plain_read(mux(payload))
        units = -(-n // 3072)
        assert got == payload and stamps == [3600 * k for k in range(units)] and points == list(range(0, units, 8))
    texts = ["", "é漢字", "x" * 191, "x" * 192, "y" * 193, "words and words " * 900, None]
    df = docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    stored = {x["doc_id"]: x["media"] for x in store_media(df).collect()}
    for x in read_media(store_media(df)).collect():
        raw = (texts[x["doc_id"]] or "").encode()
        want = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        payload, _, _ = plain_read(bytes(stored[x["doc_id"]]))
        assert payload == want and (x["n_bytes"], x["payload_bytes"], x["media_bytes"]) == (len(raw), len(want), len(stored[x["doc_id"]]))
        assert (x["payload_sha256"], x["tail_crc32"], x["media_sha256"]) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]), hashlib.sha256(bytes(stored[x["doc_id"]])).hexdigest())


def test_only_the_first_program_is_read():
    from strandline.llm import transport as T

    stream = mux(b"first" * 100)
    # a second program with a map and a stream of its own
    pat = T._section(0x00, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | m).to_bytes(2, "big") for n, m in ((1, T.PMT_PID), (2, 0x1001))))
    pmt = T._section(0x02, 2, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + bytes([6]) + (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00")
    packet = lambda pid, section: (T._packet_head(pid, True, 0, False) + b"\x00" + section).ljust(188, b"\xff")
    other = b"\x00\x00\x01\xbd" + (3 + 176).to_bytes(2, "big") + b"\x80\x00\x00" + b"z" * 175
    two = packet(0, pat) + stream[188:376] + packet(0x1001, pmt) + stream[376:] + T._packet_head(0x200, True, 0, False) + other
    s = demux(two)
    assert s.programs == {1: T.PMT_PID, 2: 0x1001} and s.first_program() == b"first" * 100 and len(s.units) == 2
