"""Secrets beside signs, of the least length, and without digits."""

from __future__ import annotations

import random

import pytest

from strandline.llm.secrets import CLASSES, entropy_spans, scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(
    ("begin", "chars", "n", "share"),
    [("KEY_", "0123456789ABCDEF", 40, 0.99), ("", "0123456789ABCDEF", 20, 0.9), ("", LETTERS + "0123456789+/", 22, 0.9), ("", LETTERS, 24, 0.95), ("a-b/", "0123456789ABCDEF", 32, 0.95)],
)
def test_random_strings_are_found(begin, chars, n, share):
    r = random.Random(7)
    made = [begin + "".join(r.choices(chars, k=n)) for _ in range(400)]
    assert sum(bool(scan(f"see {s} there")[1]) for s in made) >= share * len(made)


def test_spans_of_classes_are_one():
    secret = "KEY_" + "4F09A1B7C83D5E62" * 3
    spans = entropy_spans(f"see {secret}, {secret}")
    assert len(spans) == 2 and all(secret[4:] in f"see {secret}, {secret}"[a:b] for a, b in spans)


def test_words_numbers_and_windows():
    for allowed in ("the-quick-brown-fox-jumps", "/usr/local/share/python/big", "order-20240102030405060718"):
        assert entropy_spans(f"see {allowed} there") == []
    assert all(window <= 20 for _, window, _ in CLASSES.values())
