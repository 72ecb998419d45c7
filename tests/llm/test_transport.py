from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from strandline.llm.transport import MEDIA_PID, PACKET, demux, media_units, mux, padded, read_media, section_crc, store_media

from .conftest import ODD


@pytest.mark.parametrize("unit", [1, 7, 150, 161, 162, 163, 164, 165, 166, 167, 168, 169, 170, 171, 172, 173, 174, 175, 176, 3072])
def test_round_trip(unit):
    data = random.Random(unit).randbytes(2500)
    stream = mux(data, unit)
    s = demux(stream)
    assert len(stream) % PACKET == 0 and s.payload(MEDIA_PID) == data
    assert (s.continuity_errors, s.bad_sections, s.damaged) == (0, 0, 0)
    assert s.programs == {1: 0x1000} and s.streams == {MEDIA_PID: 6}


def test_stamps_and_random_access():
    units = demux(mux(bytes(3072 * 20))).units
    assert [u.pts for u in units] == [3600 * k for k in range(20)]
    assert [k for k, u in enumerate(units) if u.random_access] == [0, 8, 16]


def test_section_checksum():
    assert section_crc(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    stream = mux(random.Random(1).randbytes(9000))
    packets = [stream[k : k + PACKET] for k in range(0, len(stream), PACKET)]
    assert demux(b"".join(packets[:5] + packets[6:])).continuity_errors == 1
    assert demux(b"".join(packets[:5] + [packets[4]] + packets[5:])).payload(MEDIA_PID) == demux(stream).payload(MEDIA_PID)  # sent twice
    bad = bytearray(packets[1])
    bad[20] ^= 1
    assert demux(b"".join([packets[0], bytes(bad), *packets[2:]])).bad_sections == 1
    assert demux(b"x" + stream[1:]).damaged == 1 and demux(stream[:-1]).damaged >= 1
    assert demux(b"").units == []


def test_query_rows(docs):
    stored = store_media(docs(ODD))
    rows = read_media(stored).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    for i, t, *_ in ODD:
        n, payload = padded(t)
        r = by_id[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and len(payload) >= 192 and r["media_bytes"] == len(mux(payload)) and r["media_sha256"] == hashlib.sha256(mux(payload)).hexdigest()
    assert by_id[1]["feature"] == by_id[2]["feature"]
    units = media_units(stored).where("doc_id = 5").collect()
    assert sum(u["n_bytes"] for u in units) == by_id[5]["payload_bytes"]
    assert read_media(store_media(docs(ODD).limit(0))).count() == 0
