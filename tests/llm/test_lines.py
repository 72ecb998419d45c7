"""Line dedup on hosts of every size, against the rule as stated."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from strandline.llm.lines import line_report


def brute(rows, percent=5):
    totals, on = Counter(h for _, _, h in rows), Counter()
    for _, text, host in rows:
        on.update({(host, x) for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")})
    boiler = {k for k, n in on.items() if n >= 2 and n * 100 > totals[k[0]] * percent}
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x) not in boiler]
        if not any(x.strip(" \t\r\x0b\x0c") for x in kept):
            kept = lines
        out.append((i, len(lines), len(lines) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("pages", [2, 10, 40, 120])
def test_ratio_decides_at_every_host_size(docs, pages):
    r = random.Random(pages)
    rows = []
    for host in ("a", None):
        for k in range(pages):
            body = ["menu", f"own {host} {k}", "", *(f"line {r.randrange(3 * pages)}" for _ in range(4))]
            rows.append((len(rows), "\n".join(body + ["rare"] * (k < 2)), host))
    rows += [(len(rows), None, "a"), (len(rows) + 1, "", None), (len(rows) + 2, "menu", "a")]
    df = docs([(i, t, "en", h) for i, t, h in rows], clashing=False)
    got = sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text_md5"]) for x in line_report(df).collect())
    assert got == brute(rows)
    # too many lines to send everywhere: the same by a join of lines
    assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text_md5"]) for x in line_report(df, most=0).collect()) == got
    if pages > 1:
        assert all(x[2] >= 1 for x in got if rows[x[0]][1] and "own" in rows[x[0]][1])
