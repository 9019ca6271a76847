"""Problem 7: held-out test items inside corpus documents.

Every word becomes a slot of a template: a word that the items use in lower case
stays itself, a number, a unit and any other word (a name) become typed
placeholders. Windows of ``WINDOW`` template words of the documents meet those of
the items by hash. What then counts are the slots: where a window's slots hold the
same words, it is an exact seed, and exact runs of a document and an item are
chained over the differences between them; where slots differ, but every slot value
of the item stands for one value in the document, the stretch is a re-parameterised
copy (kind ``template``; at least 12 words and four windows with literal words).
Every longest stretch of equal templates on a diagonal is tried, and every longest
part of it without contradiction. As names may be of several words, templates are
also compared with each run of names as one placeholder.

Completeness: a stretch of at least 12 words with at most one word in eight changed
holds a run of five unchanged words (k changes leave n - k words in at most k + 1
runs, n >= 8 k), so its template window meets. Windows with fewer than
``LITERALS`` literal words are hashed with their slots, since a window of
placeholders would meet everything; an unchanged run meets all the same.

A window may be held by many items (a stock opening). Which of them can have a stretch
in a document is then told for all of them at once, by the words that the document
holds at all; only the others are looked at one by one.

The items are a stated query set against all documents. They are sent to the tasks
in blocks of at most ``BLOCK`` items and ``BLOCK_CHARS`` characters (or one item), so
what is broadcast has a fixed bound; a larger set takes more passes over the documents.

Defined results: null and empty texts and items shorter than 12 words match nothing;
repeated rows give one row; a document may hold several items and an item occur in
several documents; other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record

WINDOW, LITERALS = 5, 2
#: Windows that must meet on one diagonal before a stretch is tried as a re-parameterised copy.
TEMPLATE_HITS = 4
#: Items that are sent to the tasks at once, and characters of them.
BLOCK, BLOCK_CHARS = 20_000, 8 << 20
#: Meetings of documents and items that are held at once.
MEETINGS = 2_000_000
#: Least words of a stretch, and the words in which one may be changed.
LEAST, ONE_IN = 12, 8

LEAKS = "doc_id bigint, item_id string, kind string, words int, changed int"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("kind", pa.string()), ("words", pa.int32()), ("changed", pa.int32())])

_WORDS = re.compile(r"[^\W_]+").findall
#: Unit signs and names, fixed values.
UNITS = frozenset("м m км km см cm мм mm км2 km2 м2 m2 м3 m3 ха ha дка л l kg кг mw kw gw w % ч h s сек мин min метра метри метър километра километър километри хектара хектар литра литър градуса градус години година г евро eur лв души".split())
NUMBER, UNIT, NAME, GAP = 0, 1, 2, 3
_FIRST = 4
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Items:
    """Query items: their words as numbers, and the sorted hashes of their windows."""

    ids: list
    words: dict  # folded word -> number
    template: np.ndarray  # by word number its template word
    tokens: list  # by item, word numbers
    weights: list  # by item, 1 where a word (between white space) begins
    keys: np.ndarray  # sorted hashes of windows
    owner: np.ndarray  # by window its item
    place: np.ndarray  # and its position in the item
    sieve: np.ndarray
    flat: np.ndarray  # the words of all items
    base: np.ndarray  # by item its first in flat
    merged: list  # by item, positions of its words without those that go on with a run of names
    merged_keys: np.ndarray  # as keys, owner and place, of the words at these positions
    merged_owner: np.ndarray
    merged_place: np.ndarray
    merged_sieve: np.ndarray
    plain: "Flat"  # the template words of all items, and those of the merged ones
    joined: "Flat"
    shapes: list  # by length class: the first tokens of the items' words, one row each
    shape_of: np.ndarray  # by item its length class and row


@dataclass
class Flat:
    """Template words of all items one after the other, with a separator after each."""

    template: np.ndarray
    base: np.ndarray  # by item its first place
    at: np.ndarray  # by place its position in the item, at a separator the item's length

    @staticmethod
    def of(tokens: list, template: np.ndarray, kept: list) -> "Flat":
        parts, at = [np.full(LEAST, _APART)], [np.zeros(LEAST, np.int64)]
        for own, keep in zip(tokens, kept):
            parts += [template[own[keep]], np.array([_APART])]
            at += [keep, np.array([len(own)])]
        sizes = [LEAST] + [len(keep) + 1 for keep in kept]
        return Flat(np.concatenate([*parts, np.full(LEAST + WINDOW, _APART)]), np.cumsum(sizes), np.concatenate([*at, np.zeros(LEAST + WINDOW, np.int64)]))


_APART = -9
_SIEVE_BITS = 20


def tokens_of(word: str) -> list[str]:
    """The letters and digits of a word between white space, folded, cut at other signs."""
    return _WORDS(word.casefold())


def _kind(token: str) -> int:
    return NUMBER if token[0].isdigit() else UNIT if token in UNITS else NAME


def window_hashes(raw: np.ndarray, template: np.ndarray) -> np.ndarray:
    """A hash of each window of ``WINDOW`` words: of its template, or of its words
    where that has fewer than ``LITERALS`` literal words."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = np.zeros(n, np.uint64)
    b = np.zeros(n, np.uint64)
    literal = np.zeros(n, np.int8)
    for k in range(WINDOW):
        t, r = template[k : k + n], raw[k : k + n]
        a = (a ^ t.astype(np.uint64)) * _PRIME
        a ^= a >> np.uint64(29)
        b = (b ^ r.astype(np.uint64)) * _PRIME
        b ^= b >> np.uint64(31)
        literal += t >= _FIRST
    return np.where(literal >= LITERALS, a, b ^ np.uint64(0x5555))


def prepared(rows: list[tuple[str, str]]) -> Items:
    """The items (id, question) ready for matching."""
    plain: set[str] = set()
    split = []
    for ident, text in rows:
        words = (text or "").split()
        split.append((ident, [tokens_of(w) for w in words]))
        for w in words:
            plain.update(t for t, o in zip(tokens_of(w), _WORDS(w)) if o == t and not t[0].isdigit())
    plain -= UNITS
    words: dict[str, int] = {}
    template: list[int] = [NUMBER, UNIT, NAME, GAP]
    tokens, weights = [], []
    for _, parts in split:
        own, first = [], []
        for part in parts:
            for k, t in enumerate(part):
                if t not in words:
                    words[t] = len(template)
                    template.append(words[t] if t in plain else _kind(t))
                own.append(words[t])
                first.append(k == 0)
        tokens.append(np.array(own, np.int64))
        weights.append(np.array(first, np.int64))
    template_of = np.array(template, np.int64)
    merged = [_merged(template_of[own]) for own in tokens]
    asked = [i for i in range(len(tokens)) if weights[i].sum() >= LEAST]
    shapes, shape_of = _shapes(tokens, weights)
    flats = Flat.of(tokens, template_of, [np.arange(len(x)) for x in tokens]), Flat.of(tokens, template_of, merged)
    index = _indexed([(i, tokens[i]) for i in asked], template_of)
    return Items([i for i, _ in split], words, template_of, tokens, weights, *index, np.concatenate([*tokens, np.empty(0, np.int64)]), np.cumsum([0, *map(len, tokens)]), merged, *_indexed([(i, tokens[i][merged[i]]) for i in asked], template_of), *flats, shapes, shape_of)


def _shapes(tokens: list, weights: list) -> tuple[list, np.ndarray]:
    """The first tokens of items' words as matrices, by length up to a power of two, filled with -1."""
    rows: list[list] = [[] for _ in range(40)]
    shape_of = np.zeros((len(tokens), 2), np.int64)
    for i, (own, first) in enumerate(zip(tokens, weights)):
        kind = max(4, int(first.sum() - 1).bit_length())
        shape_of[i] = kind, len(rows[kind])
        row = np.full(1 << kind, -1, np.int32)
        row[: int(first.sum())] = own[first == 1]
        rows[kind].append(row)
    return [np.stack(r) if r else None for r in rows], shape_of


def _merged(template: np.ndarray) -> np.ndarray:
    """The positions of template words without those that go on with a run of names."""
    name = template == NAME
    return np.flatnonzero(~(name & np.concatenate(([False], name[:-1])))) if len(name) else np.empty(0, np.int64)


def _indexed(rows: list[tuple[int, np.ndarray]], template: np.ndarray):
    """Sorted hashes of the windows of items (number, words), their items and places, and the sieve."""
    keys, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for i, own in rows:
        h = window_hashes(own, template[own])
        keys.append(h)
        owner.append(np.full(len(h), i, np.int32))
        place.append(np.arange(len(h), dtype=np.int32))
    keys, owner, place = map(np.concatenate, (keys, owner, place))
    order = np.argsort(keys, kind="stable")
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[keys & np.uint64((1 << _SIEVE_BITS) - 1)] = True
    return keys[order], owner[order], place[order], sieve


class _Vocabulary(dict):
    """From a word between white space to its numbers: those of the items' words,
    and the placeholder's for others."""

    def __init__(self, items: Items):
        self.items_, self.several = items.words, []

    def __missing__(self, word):
        own = [self.items_.get(t, _kind(t)) for t in tokens_of(word)]
        if len(own) == 1:
            found = own[0]
        else:  # kept apart, as -1 - its place
            found = -1 - len(self.several)
            self.several.append(own)
        self[word] = found
        return found


def _numbers(text: str, vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text as numbers, and 1 where a word between white space begins."""
    own = [vocabulary[w] for w in text.split()]
    found = np.array(own, np.int64)
    if not len(found) or found.min() >= 0:
        return found, np.ones(len(found), np.int8)
    flat, first = [], []
    for x in own:
        several = vocabulary.several[-1 - x] if x < 0 else (x,)
        flat.extend(several)
        first.extend(k == 0 for k in range(len(several)))
    return np.array(flat, np.int64), np.array(first, np.int8)


def _runs(doc: np.ndarray, item: np.ndarray, pairs: set[tuple[int, int]]):
    """Longest runs of equal words through the given positions: (item start, doc start, length)."""
    doc, item = doc.tolist(), item.tolist()
    runs, upto = set(), {}
    for d, i in sorted(pairs):
        if d < upto.get(d - i, 0):
            continue
        a, b = d, i
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        n = d - a
        while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]:
            n += 1
        runs.add((b, a, n))
        upto[d - i] = a + n
    return sorted(runs)


def _near(doc, item, runs, reach):
    """The runs of two words and more around the given ones (a change may leave short runs)."""
    found = set(runs)
    for b, a, n in runs:
        for lo_i, lo_d in ((max(0, b - reach), max(0, a - reach)), (b + n, a + n)):
            wi, wd = item[lo_i : lo_i + reach], doc[lo_d : lo_d + reach]
            if len(wi) and len(wd):
                same = wd[:, None] == wi[None, :]
                for x, y in zip(*np.nonzero(same)):
                    if not (x and y and same[x - 1, y - 1]):
                        m = 1
                        while x + m < len(wd) and y + m < len(wi) and same[x + m, y + m]:
                            m += 1
                        found.add((int(lo_i + y), int(lo_d + x), m))
    return sorted(found)


def best_stretch(doc, item, weights, pairs, doc_weights=None):
    """(words, changed) of the longest stretch of the item in the document within the limits, or None.

    Runs are chained in order; between two of them the larger of the gaps in item and
    document, in words between white space, counts as changed (replaced, added or left out).
    """
    runs = _runs(doc, item, pairs)
    # a neighbour of a seed run stays within the changes that a whole item may have
    reach = (len(item) // ONE_IN + 1) * _widest(weights, doc_weights) + WINDOW
    for _ in range(3):
        more = _near(doc, item, runs, reach)
        if len(more) == len(runs):
            break
        runs = more
    before = np.concatenate(([0], np.cumsum(weights)))
    word, doc_word = np.cumsum(weights).tolist(), (np.arange(len(doc)) if doc_weights is None else np.cumsum(doc_weights, dtype=np.int64)).tolist()
    count = lambda numbers, x, y: numbers[y - 1] - numbers[x] + 1 if y > x else 0
    best = None
    cost: list[dict[int, int]] = [{} for _ in runs]  # by run: start of the chain in the item -> least changed
    for k, (b, a, n) in enumerate(runs):
        cost[k][b] = 0
        for j in range(k):
            pb, pa_, pn = runs[j]
            cut = max(0, pb + pn - b, pa_ + pn - a)  # runs that overlap: the later is shortened
            if cut >= n or pb >= b or pa_ >= a:
                continue
            if max(b + cut - pb - pn, a + cut - pa_ - pn) > reach:
                continue
            gap = max(count(word, pb + pn, b + cut), count(doc_word, pa_ + pn, a + cut))
            for start, c in cost[j].items():
                if c + gap < cost[k].get(start, 1 << 30):
                    cost[k][start] = c + gap
        for start, c in cost[k].items():
            words = int(before[b + n] - before[start])
            if words >= LEAST and c * ONE_IN <= words and (best is None or (words, -c) > (best[0], -best[1])):
                best = (words, c)
    return best


def _slot(words: list[int]):
    """What stands in a slot, or None for words that no item has: these are all one number and can't contradict each other."""
    return None if min(words) < _FIRST else tuple(words)


def _template(doc, item, template, meetings, at_doc=None, at_item=None):
    """(words, changed slots) of the longest consistent part of the template stretches through ``meetings``,
    (document, item) positions in order, all of one diagonal. at_doc, at_item: positions of the words that the
    meetings count, where runs of names are one."""
    at_doc = np.arange(len(doc)) if at_doc is None else at_doc
    at_item = np.arange(len(item)) if at_item is None else at_item
    td, ti = template[doc[at_doc]], template[item[at_item]]
    d, i = meetings[0]
    back = min(d, i)
    lo_d, lo_i = d - back, i - back
    n = min(len(td) - lo_d, len(ti) - lo_i)
    same = td[lo_d : lo_d + n] == ti[lo_i : lo_i + n]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).tolist()
    hit = np.array([x - lo_d for x, _ in meetings])
    ends_d, ends_i = np.append(at_doc, len(doc)).tolist(), np.append(at_item, len(item)).tolist()
    doc, item = doc.tolist(), item.tolist()
    best = (0, 0)
    for x, y in zip(edge[::2], edge[1::2]):
        # the part from start to k holds no contradiction; words are those of the item
        if ends_i[lo_i + y] - ends_i[lo_i + x] < LEAST or not ((hit >= x) & (hit < y)).any():
            continue
        start, seen, changed = x, {}, [0]
        for k in range(x, y):
            a, b = lo_d + k, lo_i + k
            if ti[b] < _FIRST:
                own, there = tuple(item[ends_i[b] : ends_i[b + 1]]), doc[ends_d[a] : ends_d[a + 1]]
                value = _slot(there)
                if value is not None:
                    was = seen.get(own)
                    if was and was[0] != value and was[1] >= start:
                        best = max(best, (ends_i[b] - ends_i[lo_i + start], changed[k - x] - changed[start - x]))
                        start = was[1] + 1
                    seen[own] = (value, k)
                changed.append(changed[-1] + (own != tuple(there)))
            else:
                changed.append(changed[-1])
        best = max(best, (ends_i[lo_i + y] - ends_i[lo_i + start], changed[-1] - changed[start - x]))
    return best


def _widest(*weights) -> int:
    """The most tokens of a word between white space."""
    widest = 1
    for w in weights:
        if w is not None and len(w) and not w.all():
            widest = max(widest, int(np.diff(np.append(np.flatnonzero(w), len(w))).max()))
    return widest


def _may_hold(doc, item, weights, shift, widest):
    """Whether a stretch within the limits can lie near the diagonal ``shift``: its words
    stand at most as many places off as it may have changes, unchanged ones count 1,
    changed ones 1 - ``ONE_IN``, and some stretch of 11 words of the item, or more, has
    a sum of 0 or more. (11: the item's word that isn't there may be the twelfth.)"""
    n, off = len(item), (len(item) // ONE_IN + 1) * widest
    padded = np.full(n + 2 * off, -1, np.int64)
    lo, hi = max(0, shift - off), min(len(doc), shift + n + off)
    padded[lo - shift + off : hi - shift + off] = doc[lo:hi]
    seen = (np.lib.stride_tricks.sliding_window_view(padded, 2 * off + 1) == item[:, None]).any(1)[weights == 1]
    return bool(_held(seen[None, :])[0])


def _held(seen: np.ndarray) -> np.ndarray:
    """By row, whether some stretch of LEAST - 1 words and more has a seventh of them unseen at most (one in eight changed)."""
    total = np.zeros((len(seen), seen.shape[1] + 1), np.int32)
    np.cumsum(np.where(seen, 1, 1 - ONE_IN), axis=1, out=total[:, 1:])
    least = LEAST - 1
    return (total[:, least:] >= np.minimum.accumulate(total[:, :-least], axis=1)).any(1) if seen.shape[1] >= least else np.zeros(len(seen), bool)


def _present(doc: np.ndarray, asked: np.ndarray, items: Items, known: np.ndarray) -> np.ndarray:
    """Which of the items can have a stretch in the document, by the words that it holds, wherever they stand.
    known: a scratch array of False by word number, and one more."""
    known[doc] = True
    known[:_FIRST] = False
    ok = np.zeros(len(asked), bool)
    kind, row = items.shape_of[asked].T
    for c in np.unique(kind):
        own = np.flatnonzero(kind == c)
        step = max(1, (1 << 22) >> int(c))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            ok[part] = _held(known[items.shapes[c][row[part]]])
    known[doc] = False
    return ok


def _verbatim(doc, item, weights, pairs, doc_weights=None):
    """The best stretch through the exact seeds ``pairs``, or None."""
    widest = _widest(weights, doc_weights)
    if not any(_may_hold(doc, item, weights, shift, widest) for shift in {d - j for d, j in pairs}):
        return None
    return best_stretch(doc, item, weights, set(pairs), doc_weights)


def _hits(raw, template, keys, sieve):
    """Positions of windows that some item has too, and where its equals begin and end in keys."""
    h = window_hashes(raw, template[raw])
    hit = np.flatnonzero(sieve[h & np.uint64((1 << _SIEVE_BITS) - 1)])
    lo, hi = np.searchsorted(keys, h[hit]), np.searchsorted(keys, h[hit], "right")
    return hit[hi > lo], lo[hi > lo], hi[hi > lo]


def _meetings(hits, starts, keys, owner, place, n, first, last):
    """Every meeting of a document's window with one of the items from first to last, by document, item and
    diagonal: position, document, item, place in it, number of the pair."""
    hit, lo, hi = hits
    if (first, last) != (0, n) and len(hit):  # the windows of equal hash are in order of their items
        rank = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
        both = rank * n + owner
        lo, hi = np.searchsorted(both, rank[lo] * n + first), np.searchsorted(both, rank[lo] * n + last)
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
    doc_of = np.searchsorted(starts, hit, "right") - 1
    count = hi - lo
    met = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p, k, i, j = np.repeat(hit, count), np.repeat(doc_of, count), owner[met].astype(np.int64), place[met].astype(np.int64)
    pair = k * n + i
    order = np.lexsort((p, p - j, pair))
    return tuple(x[order] for x in (p, k, i, j, pair))


def _long(template, p, j, i, flat: Flat) -> np.ndarray:
    """Which meetings stand in a stretch of equal templates of LEAST words of the item, or more."""
    ok, offsets = np.zeros(len(p), bool), np.arange(1, LEAST + 1)
    for at in range(0, len(p), 50_000):
        x, y = p[at : at + 50_000], flat.base[i[at : at + 50_000]] + j[at : at + 50_000]
        same = lambda dx, dy: np.cumprod(template[np.clip(dx, 0, len(template) - 1)] == flat.template[dy], axis=1).sum(1)
        left = same(x[:, None] - offsets, y[:, None] - offsets)
        right = same(x[:, None] + WINDOW - 1 + offsets, y[:, None] + WINDOW - 1 + offsets)
        ok[at : at + 50_000] = flat.at[y + WINDOW + right] - flat.at[y - left] >= LEAST
    return ok


def _lines(p, j, i, pair, template, flat: Flat):
    """(first, end) of the meetings of each diagonal that holds enough of them, and a long enough stretch, to be tried."""
    if not len(p):
        return np.empty((0, 2), np.int64)
    line = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | ((p - j)[1:] != (p - j)[:-1]))))
    ends = np.append(line[1:], len(p))
    many = ends - line >= TEMPLATE_HITS
    line, ends = line[many], ends[many]
    if not len(line):
        return np.empty((0, 2), np.int64)
    of = np.repeat(np.arange(len(line)), ends - line)
    own = np.repeat(line, ends - line) + np.arange(len(of)) - np.repeat(np.cumsum(ends - line) - (ends - line), ends - line)
    # one meeting of each run of them will do
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (j[own[1:]] != j[own[:-1]] + 1)))
    of, own = of[new], own[new]
    long = np.zeros(len(line), bool)
    long[of[_long(template, p[own], j[own], i[own], flat)]] = True
    return np.stack((line, ends), 1)[long]


def find(ids, texts, items: Items, vocabulary: _Vocabulary):
    """Rows (doc_id, item_id, kind, words, changed) of a slice of documents."""
    docs = []
    for ident, text in zip(ids, texts):
        if ident is None or not text:
            continue
        numbers, first_of = _numbers(text, vocabulary)
        if len(numbers) >= WINDOW:
            docs.append((ident, numbers, first_of))
    if docs and len(items.keys):
        yield from _found(docs, items, 0, len(items.ids))


def _found(docs, items: Items, first_item: int, last_item: int):
    """The rows of documents (id, words, starts of words) and the items from first to last; where these meet
    more often than MEETINGS, half of them at a time."""
    gap, n = np.full(WINDOW, GAP, np.int64), len(items.ids)
    raw = np.concatenate([x for _, numbers, _ in docs for x in (numbers, gap)])
    owner, begins = [d for d, *_ in docs], [b for *_, b in docs]
    starts = np.cumsum([0] + [len(numbers) + WINDOW for _, numbers, _ in docs])
    words = lambda k: raw[starts[k] : starts[k + 1] - WINDOW]
    template = items.template[raw]
    kept = _merged(template)
    hits, merged_hits = _hits(raw, items.template, items.keys, items.sieve), _hits(raw[kept], items.template, items.merged_keys, items.merged_sieve)
    if (last_item - first_item) / n * max((hi - lo).sum() for _, lo, hi in (hits, merged_hits)) > MEETINGS and (len(docs) > 1 or last_item - first_item > 1):
        if len(docs) > 1:
            half = len(docs) // 2
            yield from _found(docs[:half], items, first_item, last_item)
            yield from _found(docs[half:], items, first_item, last_item)
        else:
            half = (first_item + last_item) // 2
            yield from _found(docs, items, first_item, half)
            yield from _found(docs, items, half, last_item)
        return
    p, k, i, j, pair = _meetings(hits, starts[:-1], items.keys, items.owner, items.place, n, first_item, last_item)
    exact = np.ones(len(p), bool)
    for x in range(WINDOW):
        exact &= raw[p + x] == items.flat[items.base[i] + j + x]
    done = set()
    seeds = np.flatnonzero(exact)
    first = np.flatnonzero(np.concatenate(([True], pair[seeds][1:] != pair[seeds][:-1]))) if len(seeds) else []
    groups = np.split(seeds, first[1:]) if len(seeds) else []
    # a window may be held by many items: those that can't have a stretch here go out first, all at once
    heads = seeds[first] if len(seeds) else seeds
    may, known = np.zeros(len(heads), bool), np.zeros(len(items.template) + 1, bool)
    for d in np.unique(k[heads]):
        of = np.flatnonzero(k[heads] == d)
        may[of] = _present(words(d), i[heads[of]], items, known)
    for own in (groups[x] for x in np.flatnonzero(may)):
        a, s = own[0], starts[k[own[0]]]
        best = _verbatim(words(k[a]), items.tokens[i[a]], items.weights[i[a]], [(int(p[x]) - s, int(j[x])) for x in own], begins[k[a]])
        if best:
            done.add(int(pair[a]))
            yield owner[k[a]], items.ids[i[a]], "verbatim", *best
    found: dict[int, tuple[int, int]] = {}
    for a, b in _lines(p, j, i, pair, template, items.plain).tolist():
        if (one := int(pair[a])) not in done:
            s = starts[k[a]]
            best = _template(words(k[a]), items.tokens[i[a]], items.template, [(int(p[x]) - s, int(j[x])) for x in range(a, b)])
            found[one] = max(found.get(one, (0, 0)), best)
    edges = np.searchsorted(kept, starts)
    p, k, i, j, pair = _meetings(merged_hits, edges[:-1], items.merged_keys, items.merged_owner, items.merged_place, n, first_item, last_item)
    for a, b in _lines(p, j, i, pair, template[kept], items.joined).tolist():
        if (one := int(pair[a])) not in done:
            x, y = int(edges[k[a]]), int(edges[k[a] + 1]) - WINDOW
            best = _template(words(k[a]), items.tokens[i[a]], items.template, [(int(p[m]) - x, int(j[m])) for m in range(a, b)], kept[x:y] - starts[k[a]], items.merged[i[a]])
            found[one] = max(found.get(one, (0, 0)), best)
    for one, best in found.items():
        if best[0] >= LEAST:
            yield owner[one // n], items.ids[one % n], "template", *best


def _blocks(rows):
    """Lists of (id, question) within the limits of a block."""
    own, size = [], 0
    for row in rows:
        if own and (len(own) >= BLOCK or size + len(row[1]) > BLOCK_CHARS):
            yield own
            own, size = [], 0
        own.append(row)
        size += len(row[1])
    if own:
        yield own


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """LEAKS: the documents and the items that leaked into each. items: (item_id, question)."""
    known = items.select("item_id", "question").filter("item_id IS NOT NULL AND question IS NOT NULL").distinct().orderBy("item_id", "question")
    blocks = _blocks((r[0], r[1]) for r in known.toLocalIterator())
    out, own = None, next(blocks, [])
    while own or out is None:
        block = documents.sparkSession.sparkContext.broadcast(prepared(own))

        def run(batches, block=block):
            own = block.value
            vocabulary = _Vocabulary(own)
            for b in pieces(batches):
                if len(vocabulary) > 300_000:
                    vocabulary = _Vocabulary(own)
                got = list(find(b.column(0).to_pylist(), b.column(1).to_pylist(), own, vocabulary))
                yield record(_LEAKS, *(map(list, zip(*got)) if got else [[] for _ in _LEAKS]))

        one = documents.select("doc_id", "text").mapInArrow(run, LEAKS)
        out = one if out is None else out.unionByName(one)
        own = next(blocks, [])
    return out.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("kind", "words", "changed"), F.struct(F.col("kind") == "template", -F.col("words"), "changed")).alias("x")).select("doc_id", "item_id", "x.*")
