"""Small helpers on single texts, for tasks that hold them anyway."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick


def first_places(text: str, words: Iterable[str]) -> dict[str, int]:
    """Where each word first stands in a text, from one walk over it; words that don't occur are left out."""
    automaton, left = ahocorasick.Automaton(), 0
    for word in words:
        left += automaton.add_word(word, word)
    first: dict[str, int] = {}
    if not left:
        return first
    automaton.make_automaton()
    for end, word in automaton.iter(text):
        if word not in first:
            first[word] = end - len(word) + 1
            if len(first) == left:
                break
    return first


def first_lines(text: str, words: Iterable[str]) -> dict[str, int]:
    """The line, from 1, on which each word first stands."""
    feeds = [m.start() for m in re.finditer("\n", text)]
    return {word: 1 + bisect_left(feeds, at) for word, at in first_places(text, words).items()}
