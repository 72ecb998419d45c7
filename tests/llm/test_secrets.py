from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from strandline.llm import secrets
from strandline.llm.secrets import scan, scan_secrets, windows

from .conftest import ODD


def brute_base(text):
    """The patterns as they are stated, matches that fail dropped afterwards."""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_against_the_patterns_as_stated():
    r = random.Random(1)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "toKen", "ſecret", '"', "'", " ", ":", "=", "abc", "abcdef1", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "é", "\n", "."]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        assert scan(text)[0] == brute_base(text), text


def test_windows_against_entropies():
    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("abcdefgh0123"[: r.randrange(1, 13)]) for _ in range(r.randrange(1, 60)))
        window, least = r.randrange(2, 25), r.random() * 4
        covered = set()
        for i in range(len(s) - window + 1):
            c = Counter(s[i : i + window])
            if -sum(n / window * math.log2(n / window) for n in c.values()) >= least - 1e-12:
                covered |= set(range(i, i + window))
        found = set()
        for a, b in windows(s, window, least):
            found |= set(range(a, b))
        assert found == covered


def test_entropy_adds_spans_and_spares_the_allowed():
    secret = "q7Xk2PzW9mR4tY8uB3nV6cL1"
    assert scan(f"see {secret} there")[1] == [(4, 3, 4 + len(secret))]
    for allowed in ("123e4567-e89b-12d3-a456-426614174000", "2024-01-02/2024-03-04-55", "abcdefghijklmnop0123456789", "internationalization2024", "thetionerentsthhereaned"):
        assert scan(f"see {allowed} there")[1] == []
    assert [k for _, k, _ in scan(f"token={secret}")[1]] == [0]


def test_query_rows(docs):
    rows = scan_secrets(docs([*ODD, (9, "é password: hunter22", None, None)])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 1
    assert by_id[1]["spans"] == "" and by_id[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() == by_id[5]["base_sha256"]
    assert by_id[9]["spans"] == "assign:2:20" and by_id[9]["n_assign"] == 1 and by_id[9]["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    assert scan_secrets(docs(ODD).limit(0)).count() == 0
    assert set(secrets.KINDS) == {"assign", "access", "hex", "entropy"}
