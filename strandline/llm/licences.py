"""Licence scans (operator 4): phrases, and template coverage by a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import annotate

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as licences ask to place them in files, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box
        1866, Mountain View, CA 94042, USA.""",
}

#: Matches of fewer words are chance.
MATCH_WORDS = 6
#: Covered share of a template's words from which its label is given.
COVERED = 0.5

# Word characters are digits, letters and everything beyond ASCII; bytes of UTF-8 show them as well as code points do.
_SEEN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lowered, as UTF-8."""
    return (text or "").encode().translate(_SEEN).split()


@dataclass
class Match:
    """Words ``start`` to ``end`` of a text are words ``at[i]`` onwards of template ``i``, at each listed place."""

    start: int
    end: int
    places: list[tuple[int, int]]


class TemplateAutomaton:
    """Generalised suffix automaton of several token sequences."""

    def __init__(self, templates: Sequence[Sequence[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, end) of the state's longest string
        self.lengths = [len(t) for t in templates]
        for n, tokens in enumerate(templates):
            state = 0
            for i, w in enumerate(tokens):
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
                self.ends[state].add((n, i + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()
        self.holders = [sorted({n for n, _ in e}) for e in self.ends]  # templates that a state's strings stand in

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of state ``q`` for its strings that ``p`` and shorter ones lead to."""
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        there = self.next[last].get(token)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, token)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def statistics(self, tokens: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """For each token the longest template substring that ends there: (state, length)."""
        known, nexts, links, lengths = self.ids.get, self.next, self.link, self.length
        state = length = 0
        for w in tokens:
            token = known(w)
            if token is None:
                state = length = 0
            else:
                while state and token not in nexts[state]:
                    state = links[state]
                    length = lengths[state]
                got = nexts[state].get(token)
                state, length = (0, 0) if got is None else (got, length + 1)
            yield state, length

    def matches(self, tokens: Sequence[bytes], least: int = MATCH_WORDS) -> list[Match]:
        """Matches of ``least`` words or more, by place in the text.

        Every template has statistics of its own: where the longest match of
        all isn't in it, the longest one that is. Of each template's matches
        those that can't be made longer count, cut so that none overlaps an
        earlier one of the same template.
        """
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        done = [0] * len(self.lengths)
        open_: dict[int, tuple[int, int]] = {}  # template: (state, length) of its match that ends here

        def close(n: int, end: int) -> None:
            state, length = open_[n]
            start = max(end - length, done[n])
            if end - start >= least:
                found.setdefault((start, end), []).extend((n, e - (end - start)) for t, e in self.ends[state] if t == n and e >= length)
                done[n] = end

        i = -1
        for i, (state, length) in enumerate(self.statistics(tokens)):
            now = self._by_template(state, length, least) if length >= least else {}
            if open_:
                for n, (_, before) in open_.items():
                    if n not in now or now[n][1] != before + 1:
                        close(n, i)
            open_ = now
        for n in open_:
            close(n, i + 1)
        return [Match(start, end, sorted(places)) for (start, end), places in sorted(found.items())]

    def _by_template(self, state: int, length: int, least: int) -> dict[int, tuple[int, int]]:
        """template: (state, length) of the longest string that ends here and stands in it, of ``least`` words or more."""
        out: dict[int, tuple[int, int]] = {}
        while state > 0 and length >= least:
            for n in self.holders[state]:
                out.setdefault(n, (state, length))
            state = self.link[state]
            length = self.length[state]
        return out

    def chain(self, found: Sequence[Match], template: int) -> list[tuple[int, int, int]]:
        """(text start, template start, words) of the matches that, in the same order in both, cover most of a template.

        The best cover that ends at or before a place of the template is kept
        in a binary indexed tree, so ``m`` places take m log(template) steps.
        """
        size = self.lengths[template]
        best: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # (covered words, link of the chain)
        links: list[tuple[int, int, int, int]] = []
        for m in found:
            words_, new = m.end - m.start, []
            for n, at in m.places:
                if n != template:
                    continue
                i, top = at, (0, -1)
                while i > 0:
                    top = max(top, best[i], key=lambda x: x[0])
                    i &= i - 1
                new.append((at + words_, top[0] + words_, len(links)))
                links.append((m.start, at, words_, top[1]))
            for end, covered, link in new:
                i = end
                while i <= size:
                    if best[i][0] < covered:
                        best[i] = (covered, link)
                    i += i & -i
        i, top = size, (0, -1)
        while i > 0:
            top = max(top, best[i], key=lambda x: x[0])
            i &= i - 1
        out, link = [], top[1]
        while link >= 0:
            out.append(links[link][:3])
            link = links[link][3]
        return out[::-1]


@lru_cache(maxsize=1)
def standard() -> tuple[tuple[str, ...], TemplateAutomaton]:
    return tuple(TEMPLATES), TemplateAutomaton([words(t) for t in TEMPLATES.values()])


@lru_cache(maxsize=1)
def _phrases() -> dict[bytes, list[tuple[tuple[bytes, ...], str]]]:
    out: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
    for p, label in PHRASES.items():
        w = tuple(p.encode().split())
        out.setdefault(w[0], []).append((w, label))
    return out


def phrase_places(tokens: Sequence[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively, in order."""
    out = []
    for first, options in _phrases().items():
        at = -1
        for _ in range(tokens.count(first)):
            at = tokens.index(first, at + 1)
            out += [(at, label) for w, label in options if tuple(tokens[at : at + len(w)]) == w]
    return sorted(out)


def scan(text: str | None) -> dict:
    """Phrase places, labels, and the covered spans of templates in one text."""
    tokens = words(text)
    base = phrase_places(tokens)
    labels, score, spans = {label for _, label in base}, 0.0, []
    names, automaton = standard()
    found = automaton.matches(tokens)
    for n in sorted({n for m in found for n, _ in m.places}):
        chain = automaton.chain(found, n)
        share = sum(c[2] for c in chain) / automaton.lengths[n]
        score = max(score, share)
        if share >= COVERED:
            labels.add(names[n])
        spans.append((names[n], share, chain))
    return {
        "n_words": len(tokens),
        "base": base,
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted(labels)),
        "score": min(1.0, score),
        "spans": spans,
    }


def scan_licences(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus word and phrase counts, labels, covered spans and the best coverage for every whole text.

    ``covered`` lists label:text word-template word-words for each chained
    match. A null or empty text has no words, no labels and score 0; a very
    long one is read whole, word by word; repeated rows give repeated results;
    an empty table gives an empty one; other columns are ignored.
    """

    def run(texts):
        rows = []
        for t in texts:
            r = scan(t)
            at = [i for i, _ in r["base"]]
            covered = ";".join(f"{name}:" + "+".join(f"{a}-{b}-{n}" for a, b, n in chain) for name, _, chain in r["spans"])
            rows.append((r["n_words"], len(at), at[0] if at else None, at[-1] if at else None, r["base_labels"], r["labels"], r["score"], covered))
        return list(zip(*rows, strict=True))

    fields = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, covered string"
    return annotate(df, [text], fields, lambda: run, keep)
