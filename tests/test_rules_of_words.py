"""Literals that are whole words are looked up among a text's words; what they find is what their patterns find."""

import random

import pyarrow as pa
import regex

from lexmill.operators import ruletable


def test_whole_words_as_by_their_patterns():
    r = random.Random(3)
    patterns = [r"\bab\b", r"\bé\b", r"\ba_b\b", r"\b-a\b", r"\ba b\b", r"ab", r"\bab", r"\b12\b", r"\bab\b"]
    automaton = ruletable.Automaton([(f"r{k}", p, False) for k, p in enumerate(patterns)])
    assert set(automaton.whole) == {"ab", "é", "a_b", "12"} and automaton.whole["ab"] == [0, 8]
    texts = ["".join(r.choice("aab é_-12.́") for _ in range(r.randint(0, 60))) for _ in range(400)] + [None, ""]
    want = [sorted((f"r{k}", m.start(), m.end(), m[0]) for k, p in enumerate(patterns) for m in regex.finditer(p, t or "")) for t in texts]
    found = ruletable._columns(automaton, texts)
    assert isinstance(found, pa.ListArray)
    assert [sorted(tuple(s.values()) for s in each) for each in found.to_pylist()] == want and sum(map(len, want)) > 400
