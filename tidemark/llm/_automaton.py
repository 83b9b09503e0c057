"""Normalised texts and Aho-Corasick automata over them.

A normalised text is its lower-cased words with one space around each. It is kept as
UTF-8 bytes that are read as Latin-1, so that a place in it is a byte, whatever the
script.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np

#: A word, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_built: dict[str, ahocorasick.Automaton] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def build(key: str, patterns: Iterable[bytes]) -> ahocorasick.Automaton | None:
    """The automaton whose values are the patterns' numbers; a worker process keeps the last one that it built."""
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            found.add_word((b" " + pattern + b" ").decode("latin-1"), k)
        if len(found):
            found.make_automaton()
        _built[key] = found
    return _built[key] if len(_built[key]) else None


def places(automaton: ahocorasick.Automaton | None, normal: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, last word) of each occurrence in a text's words."""
    if automaton is None or not normal:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = b" " + b" ".join(normal) + b" "
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, patterns = np.array(hits, np.int64).T
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    return patterns, np.searchsorted(gaps, ends) - 1


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word in the original's code points."""
    return [m.span() for m in WORD.finditer(text.translate(FOLD))]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of true."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
