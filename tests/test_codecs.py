"""Block codecs: round trips with every flag, and streams as other writers make them."""

from __future__ import annotations

import random

import pytest

from strandline.sources import adaptive, codecs, names, nx16, packing


def samples():
    r = random.Random(1)
    yield from (b"", b"a", b"ab", b"abc" * 5, b"a" * 1000, bytes(range(256)) * 3, r.randbytes(3000), bytes(r.choice(b"ACGT") for _ in range(2001)))
    yield bytes(r.choice(b"ACGTN\0") for _ in range(777)) + b"\xff" * 300 + b"x"
    yield b"".join(bytes([r.choice(b"IIIHG#")]) * r.randrange(1, 9) for _ in range(300))


@pytest.mark.parametrize("flags", [0, 1, 4, 5, 8, 9, 32, 64, 65, 68, 128, 129, 192, 193, 197, 8 | 64 | 1, 16])
def test_rans_of_many_lanes(flags):
    for data in samples():
        packed = nx16.encode(data, flags)
        assert nx16.decode(packed, len(data) if flags & packing.NO_SIZE else None) == data


@pytest.mark.parametrize("flags", [0, 1, 4, 8, 9, 32, 64, 65, 128, 129, 192, 193, 16])
def test_arithmetic_coding(flags):
    for data in samples():
        assert adaptive.decode(adaptive.encode(data, flags), len(data) if flags & packing.NO_SIZE else None) == data


def test_models_stay_within_their_limit():
    data = b"a" * 40_000 + bytes(range(256)) * 20
    packed = adaptive.encode(data)
    assert adaptive.decode(packed) == data and len(packed) < len(data) / 3


def test_qualities():
    r = random.Random(2)
    records = [bytes(max(0, min(45, 30 + r.randrange(-3, 4))) for _ in range(100)) for _ in range(30)]
    records[7] = records[6]
    data = b"".join(records)
    packed = adaptive.encode_qualities(data, [100] * 30)
    assert adaptive.decode_qualities(packed) == data and len(packed) < len(data) * 0.6
    lengths = [r.randrange(1, 300) for _ in range(20)]
    data = r.randbytes(sum(lengths))
    assert adaptive.decode_qualities(adaptive.encode_qualities(data, lengths)) == data
    for data in samples():
        assert adaptive.decode_qualities(adaptive.encode_qualities(data)) == data
    for table in ([0] * 1024, [min(7, i >> 4) for i in range(1024)], [i for i in range(256)], [0] * 255 + [1], [0] * 256):
        assert adaptive.read_steps(packing.Source(adaptive.write_steps(table)), len(table)) == table


@pytest.mark.parametrize("by", [False, True])
def test_names(by):
    r = random.Random(3)
    lists = [
        [],
        [b"a"],
        [b"SRR001.%d" % i for i in range(50)],
        [b"I17:%04d:%d:%d" % (i // 3, r.randrange(10**6), r.randrange(100)) for i in range(60)] * 2,
        [b"x", b"x", b"", b"0", b"00", b"007", b"008", b"10", b"4294967296123", b"a-b_c.1/2"] * 3,
        [r.randbytes(9).replace(b"\0", b"!") for _ in range(20)],
    ]
    for found in lists:
        data = b"".join(x + b"\0" for x in found)
        assert names.decode(names.encode(data, by)) == data
    many = b"".join(b"run7:lane%d:%07d\0" % (i % 3, i * 3) for i in range(500))
    assert len(names.encode(many, by)) < len(many) / 8


def test_a_stream_of_types_that_is_left_out():
    # a position that only the first name has a token of its own at: the rest match it
    packed = bytearray(names.encode(b"ab\0ab1\0"))
    assert names.decode(bytes(packed)) == b"ab\0ab1\0"
    types = nx16.encode(bytes([names.DIFFERENT] * 2))
    streams = bytes([0x80 | names.TYPE]) + packing.uint7(len(types)) + types
    far = nx16.encode(b"\0\0\0\0\1\0\0\0")
    streams += bytes([names.DIFFERENT]) + packing.uint7(len(far)) + far
    word = nx16.encode(b"name\0")
    streams += bytes([0x80 | names.STRING]) + packing.uint7(len(word)) + word
    ends = nx16.encode(bytes([names.END] * 2))
    streams += bytes([0x80 | names.TYPE]) + packing.uint7(len(ends)) + ends
    assert names.decode(b"\x0a\0\0\0\2\0\0\0\0" + streams) == b"name\0name\0"


def test_damaged_streams_raise():
    r = random.Random(4)
    data = bytes(r.choice(b"ACGT") for _ in range(300))
    for method in ("rans0", "nx16", "nx16+1", "nx16+193", "arith+65", "arith+129", "names", "fqzcomp"):
        packed = codecs.compress(method, data + b"\0" if method == "names" else data)
        for cut in (1, 3, len(packed) // 2):
            try:
                assert codecs.decompress(method, packed[:cut], len(data)) != data
            except (codecs.CodecError, ValueError, IndexError, ZeroDivisionError, OSError, __import__("struct").error):
                pass
    with pytest.raises(codecs.CodecError):
        codecs.compress("none such", b"x")
