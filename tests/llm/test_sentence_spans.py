"""Sentences: spans scored as wholes, words looked at whole, odd long texts."""

from __future__ import annotations

import time

import pytest

from litloom.llm import sentences


def split(t: str) -> list[str]:
    return [t[a:b] for a, b in sentences.spans(t)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Badanie prof. Nowak i in. wykazało."],
        ["Er wohnt in der Müllerstr. 5.", "Sie geht."],
        ["Er wohnt in der Müllerstr. 5 und bleibt.", "Sie geht."],
        ["It began.", "5 cells grew well."],
        ["Stop.", "Go on!", "why now?", "Because of " + "x" * 80 + ".", "It ended."],
        ["The " + "very-" * 30 + "long word ended.", "Then another one began."],
        ["He said \"" + "It is so. " * 80 + "It ends.\" to them.", "Done."],
        ["The board (" + "one. " * 40 + "two) stood there.", "Done."],
        ["研究" * 40 + "vs.对照组的差异。", "完。"],
    ],
)
def test_spans_as_wholes(parts):
    assert split(" ".join(parts)) == parts


def test_short_rest_belongs_to_its_sentence():
    """The same dot closes a sentence before a long span and none before a short weak one: the span decides."""
    assert split("They used Xyz. five more of the animals later on.") == ["They used Xyz.", "five more of the animals later on."]
    assert split("They used Xyz. five.") == ["They used Xyz. five."]


@pytest.mark.parametrize("t", ["A." * 40000, "! " * 40000, "( " * 20000 + ". " * 20000, "a.b " * 20000, '"x. ' * 20000, "ก " * 20000, "." * 80000, " " * 80000])
def test_odd_long_texts_take_linear_time(t):
    began = time.time()
    got = sentences.spans(t)
    assert time.time() - began < 30 and all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
