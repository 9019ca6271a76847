"""Problem 2: items over the size limit, cut at natural boundaries.

Every word of an item is a possible start of a piece. A merge of the start
positions with the sorted boundaries joins each start to its farthest legal end
(both limits, not past the section) and so to its successor: the end less the
overlap. Squaring that successor table, ``jump = jump[jump]``, doubles the steps
it takes; marking what is reached after each squaring derives all cuts of all
items of a batch in a logarithmic number of array operations, without following
any chain. An item is one row and stays where it was read: nothing is shuffled.

Defined results: an item within both limits comes out as one piece, as it is
stored. Null texts give no piece. An oversized item without words, or a section
without body, gives one piece (the heading, or an empty text). A word longer than
the character limit is cut inside. Where fewer than ``overlap`` + 1 words fit,
the overlap shrinks so that each piece moves on. Repeated rows each give theirs.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import pieces, record

PIECES = "src string, item_id bigint, title string, section string, piece_index int, pieces int, words int, oversized boolean, text string"
_PIECES = pa.schema([("src", pa.string()), ("item_id", pa.int64()), ("title", pa.string()), ("section", pa.string()), ("piece_index", pa.int32()), ("pieces", pa.int32()), ("words", pa.int32()), ("oversized", pa.bool_()), ("text", pa.string())])


@dataclass(frozen=True)
class Limits:
    """Most words and characters (code points) of a piece, the words that
    consecutive pieces of a section share, and the longest heading: what stands
    between equal signs and is longer is text, since a heading isn't cut."""

    words: int = 196
    chars: int = 2000
    overlap: int = 24
    heading: int = 200


_HEADING = re.compile(r"(?<!=)(={2,6})(?!=)(?=[^=\n]*[^=\s])([^=\n]++)(?<!=)\1(?!=)")
#: Signs that end a sentence, and those that may follow one.
_ENDS, _CLOSERS = ".!?…。", "\"'”“’»)]"

_class: np.ndarray | None = None
_BLANK, _LINE, _END, _CLOSE = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """By code point: white space, line end, sentence end, closing sign."""
    global _class
    if _class is None:
        _class = np.fromiter((_BLANK * chr(i).isspace() for i in range(0x110000)), np.uint8, 0x110000)
        for signs, bit in (("\n\r  \x0b\x0c", _LINE), (_ENDS, _END), (_CLOSERS, _CLOSE)):
            for x in signs:
                _class[ord(x)] |= bit
    return _class


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    full = np.empty(len(codes) + 2, np.int8)
    full[0] = full[-1] = 0
    np.equal(_classes()[codes] & _BLANK, 0, out=full[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(full))
    return edge[::2], edge[1::2]


def _cut_long(starts, ends, most):
    """Words longer than ``most`` characters as several."""
    if not len(starts) or (ends - starts).max() <= most:
        return starts, ends
    parts = -((starts - ends) // most)
    at = np.repeat(starts, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return at, np.minimum(at + most, np.repeat(ends, parts))


def successors(starts, ends, stop, level, limits: Limits):
    """For each word as start of a piece the end of the piece (a word position),
    and the start of the next (the number of words where there is none).

    stop: by word the end of its section. level: by word 2 if a paragraph ends
    with it, 1 if a sentence does, else 0.
    """
    n = len(starts)
    here = np.arange(n)
    end = np.minimum(np.minimum(here + limits.words, np.searchsorted(ends, starts + limits.chars, "right")), stop)
    end = np.maximum(end, here + 1)
    last = lambda least: np.concatenate(([0], np.maximum.accumulate(np.where(level >= least, here + 1, 0))))[end]
    sentence, paragraph = last(1), last(2)
    ended = end == stop
    least = here + limits.overlap
    chosen = np.where(paragraph > np.maximum(least, here + (end - here) // 2), paragraph, np.where(sentence > least, sentence, end))
    end = np.where(ended, end, chosen)
    following = np.where(ended, n, np.maximum(end - limits.overlap, here + 1))
    return end, following


def reached(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which positions the chains from ``first`` pass, by squaring the successor table."""
    n = len(following)
    jump = np.append(following, n)
    mark = np.zeros(n + 1, bool)
    mark[first] = True
    while True:
        at = np.flatnonzero(mark[:n])
        to = jump[at]
        if (to == n).all():
            return mark[:n]
        mark[to] = True
        jump = jump[jump]


def _natural(codes, starts, ends):
    """By word: 2 if a line ends after it, 1 if it ends a sentence, else 0."""
    kind = _classes()[codes]
    lines = np.concatenate(([0], np.cumsum(kind & _LINE > 0)))
    level = np.zeros(len(starts), np.int8)
    tail = ends - 1
    for _ in range(3):
        closing = (kind[tail] & _CLOSE > 0) & (tail > starts)
        tail = np.where(closing, tail - 1, tail)
    level[kind[tail] & _END > 0] = 1
    if len(starts):
        after = np.append(starts[1:], len(codes))
        level[lines[after] > lines[ends]] = 2
    return level


def _sections(text: str, starts: np.ndarray, given: str | None, longest: int):
    """(name, heading, first word, end word) of the stretches between headings."""
    at, name, heading, out = 0, given, None, []
    for m in _HEADING.finditer(text):
        own = m.group(2).strip()
        if len(own) > longest:
            continue
        out.append((name, heading, at, m.start()))
        at, name, heading = m.end(), own, m.group()
    out.append((name, heading, at, len(text)))
    lo = np.searchsorted(starts, [x[2] for x in out])
    hi = np.searchsorted(starts, [x[3] for x in out])
    return [(n, h, int(a), int(b)) for (n, h, _, _), a, b in zip(out, lo, hi)]


class _Out:
    def __init__(self):
        self.rows = [[] for _ in _PIECES]

    def add(self, *values):
        for c, v in zip(self.rows, values):
            c.append(v)


def _cut_all(items, limits: Limits):
    """The pieces of a slice of items (src, id, title, section, text)."""
    out = _Out()
    large, base, chars = [], 0, 0
    S, E, STOP, LEVEL, FIRST = [], [], [], [], []
    for src, ident, title, section, text in items:
        if text is None or ident is None:
            continue
        if len(text) <= limits.chars and (len(text) < 2 * limits.words or len(text.split()) <= limits.words):
            out.add(src, ident, title, section, 0, 1, len(text.split()), False, text)
            continue
        codes = _codes(text)
        words = spans(codes)
        if len(text) <= limits.chars and len(words[0]) <= limits.words:
            out.add(src, ident, title, section, 0, 1, len(words[0]), False, text)
            continue
        s, e = _cut_long(*words, limits.chars)
        parts = _sections(text, s, section, limits.heading)
        stop = np.full(len(s), len(s))
        for _, _, a, b in parts:
            stop[a:b] = b + base
            if b > a:
                FIRST.append(a + base)
        large.append((src, ident, title, text, s, e, parts, base))
        # positions of the items of the slice follow one another, with room for a piece between
        S.append(s + chars), E.append(e + chars), STOP.append(stop), LEVEL.append(_natural(codes, s, e))
        base += len(s)
        chars += len(text) + limits.chars + 1
    if not large:
        return record(_PIECES, *out.rows)
    S, E, STOP, LEVEL = map(np.concatenate, (S, E, STOP, LEVEL))
    end, following = successors(S, E, STOP, LEVEL, limits)
    on = reached(np.array(FIRST, np.int64), following)
    for src, ident, title, text, s, e, parts, base in large:
        found = []
        for name, heading, a, b in parts:
            if a == b:
                if heading:
                    found.append((name, 0, heading))
                continue
            for i in np.flatnonzero(on[base + a : base + b]) + a:
                j = int(end[base + i]) - base
                found.append((name, j - i, text[s[i] : e[j - 1]]))
        # an item was over a limit if what came out isn't one piece as it is stored
        cut = len(found) != 1 or found[0][2] != text
        for k, (name, n, piece) in enumerate(found or [(None, 0, "")]):
            out.add(src, ident, title, name, k, max(1, len(found)), n, cut, piece)
    return record(_PIECES, *out.rows)


def split_items(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of items (src, item_id, title, section, text), see PIECES; ``oversized``
    says whether the stored text was over a limit."""

    def run(batches):
        for b in pieces(batches, rows=400, size=4 << 20):
            yield _cut_all(zip(*(c.to_pylist() for c in b.columns)), limits)

    return items.select("src", "item_id", "title", "section", "text").mapInArrow(run, PIECES)
