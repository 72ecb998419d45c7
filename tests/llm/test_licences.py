from __future__ import annotations

import random
import re

from strandline.llm import licences
from strandline.llm.licences import MATCH_WORDS, TEMPLATES, TemplateAutomaton, scan, scan_licences

from .conftest import ODD


def substrings_ending(templates, tokens, i):
    return max(k for k in range(i + 2) if k == 0 or any(t[j : j + k] == tokens[i + 1 - k : i + 1] for t in templates for j in range(len(t) - k + 1)))


def test_automaton_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        templates = [[bytes([97 + r.randrange(3)]) for _ in range(r.randrange(14))] for _ in range(r.randrange(1, 4))]
        a = TemplateAutomaton(templates)
        tokens = [bytes([97 + r.randrange(4)]) for _ in range(30)]
        for i, (state, length) in enumerate(a.statistics(tokens)):
            assert length == substrings_ending(templates, tokens, i)
            if length:
                places = {(n, j + length) for n, t in enumerate(templates) for j in range(len(t) - length + 1) if t[j : j + length] == tokens[i + 1 - length : i + 1]}
                assert {(n, e) for n, e in a.ends[state] if e >= length} == places


def test_a_match_of_one_template_hides_no_other():
    p, q = [list(x.encode()) for x in ("pqabcdefghij", "abcdefgh")]
    tokens = [bytes([c]) for c in b"zpqabcdefghz"]
    a = TemplateAutomaton([[bytes([c]) for c in p], [bytes([c]) for c in q]])
    found = a.matches(tokens)
    assert a.chain(found, 0) == [(1, 0, 10)] and a.chain(found, 1) == [(3, 0, 8)]


def test_matches_of_each_template_against_brute_force():
    r = random.Random(8)
    for _ in range(200):
        templates = [[bytes([97 + r.randrange(3)]) for _ in range(r.randrange(1, 14))] for _ in range(3)]
        tokens = [bytes([97 + r.randrange(4)]) for _ in range(30)]
        want = set()
        for n, t in enumerate(templates):
            ends = [substrings_ending([t], tokens, i) for i in range(len(tokens))]
            done = 0
            for i, k in enumerate(ends):
                if k >= 2 and (i + 1 == len(ends) or ends[i + 1] != k + 1) and i + 1 - max(done, i + 1 - k) >= 2:
                    start = max(done, i + 1 - k)
                    size, done = i + 1 - start, i + 1
                    # where the whole match stands, cut by what an earlier one covers
                    want |= {(start, i + 1, n, j + k - size) for j in range(len(t) - k + 1) if t[j : j + k] == tokens[i + 1 - k : i + 1]}
        got = {(m.start, m.end, n, at) for m in TemplateAutomaton(templates).matches(tokens, 2) for n, at in m.places}
        assert got == want


def test_chains_are_the_best_cover():
    r = random.Random(4)
    for _ in range(150):
        template = [bytes([97 + r.randrange(4)]) for _ in range(12)]
        a = TemplateAutomaton([template])
        found = a.matches([bytes([97 + r.randrange(5)]) for _ in range(40)], 2)
        for x, y in zip(found, found[1:]):
            assert x.end <= y.start

        def best(k, at):
            if k == len(found):
                return 0
            n = found[k].end - found[k].start
            return max([best(k + 1, at)] + [n + best(k + 1, p + n) for _, p in found[k].places if p >= at])

        chain = a.chain(found, 0)
        assert sum(c[2] for c in chain) == best(0, 0)
        for start, at, n in chain:
            assert n >= 2 and at + n <= len(template)


def test_base_against_words_as_stated(docs):
    r = random.Random(5)
    parts = ["GNU", "general", "Public", "License", "apache", "license", "CC", "by", "MIT", " ", "-", "\n", "é", "`", "{", "Key", "x1", "İ"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for _ in range(2000):
        text = "".join(r.choice(parts) + r.choice([" ", "", ", "]) for _ in range(r.randrange(15)))
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        base = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        got = scan(text)
        assert (got["n_words"], got["base"]) == (len(w), base)


def test_templates_are_found_whole_and_in_part():
    for label, text in TEMPLATES.items():
        got = scan(f"before {text.upper()} after")
        assert label in got["labels"].split(",") and got["score"] == 1.0
    words = TEMPLATES["bsd"].split()
    words[40] = "changed"
    assert scan(" ".join(words))["score"] > 0.9 and "bsd" in scan(" ".join(words))["labels"]
    assert scan("permission to use is not given")["labels"] == "" and MATCH_WORDS > 3


def test_query_rows(docs):
    rows = scan_licences(docs([*ODD, (9, "CC BY x the MIT License", None, None)])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 1
    assert (by_id[1]["n_words"], by_id[1]["n_base"], by_id[1]["first_word"], by_id[1]["labels"], by_id[1]["score"]) == (0, 0, None, "", 0.0)
    assert by_id[5]["n_words"] == 30_000
    r = by_id[9]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (6, 2, 0, 4, "cc-by,mit")
    assert scan_licences(docs(ODD).limit(0)).count() == 0
