from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as vocab
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.bpe import EditableEncoding, TextCodec, bpe_encode, load_ranks

from .conftest import ODD

PATH = vocab.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return TextCodec(load_ranks(PATH), vocab.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_few_letters_as_the_library(codec, library):
    r = random.Random(5)
    for letters in ("ab", "the ", " \n\t\x1c\x85　x", "éàß ", "0 1'", "\xaa\xb2\xbd a1"):
        for _ in range(200):
            text = "".join(r.choice(letters) for _ in range(r.randrange(1, 80)))
            assert codec.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_equal_encoding_anew(codec):
    r = random.Random(6)
    for _ in range(60):
        data = bytes(r.choice(b"the ratio") for _ in range(300))
        e = EditableEncoding(codec.bpe, data)
        e.append(b"inations")
        data += b"inations"
        fresh = EditableEncoding(codec.bpe, data)
        assert e.last == fresh.last
        a = r.randrange(len(data))
        b = min(len(data), a + r.randrange(6))
        new = bytes(r.choice(b"xyz th") for _ in range(r.randrange(6)))
        done = e.replace(a, b, new)
        data = data[:a] + new + data[b:]
        fresh = EditableEncoding(codec.bpe, data)
        assert e.last == fresh.last and e.ids() == fresh.ids()
        assert done <= len(data) - a


def test_an_edit_recomputes_little(codec):
    data = b" the ratio of the nation" * 400
    e = EditableEncoding(codec.bpe, data)
    assert e.replace(50, 53, b"xyz") < 400


def test_query_rows(docs, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_encode(docs(ODD), PATH, vocab.PATTERN, digests=True).collect()}
    want = set()
    for i, t, *_ in ODD:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_ids_and_bytes(docs, library):
    df = docs([(1, "the nation", None, None)])
    row = bpe_encode(df, PATH, vocab.PATTERN, keep=["doc_id", "n_tokens"]).first()
    assert row["token_ids"] == library.encode_ordinary("the nation") and bytes(row["decoded"]) == b"the nation" and row["n_tokens"] == 2
    assert bpe_encode(df.limit(0), PATH, vocab.PATTERN).count() == 0
