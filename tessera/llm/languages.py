"""Problem 8: languages of documents and of the stretches of mixed ones.

A word's script narrows the languages it may be in; the letter triples of a word
give it a score in each of those. Viterbi over the words of a text, with a penalty
for a change of language that is smaller where a sentence ends, labels spans.

The scores are fitted on a bounded sample (about ``SAMPLE_ROWS`` rows, those whose
hashed id lies below a bound, each of at most ``SAMPLE_CHARS`` characters so that its
size is bounded too) of rows whose label names one of the languages; labels may be wrong, so
the sample is labelled again by the first fit and fitted once more. Labelling covers
whole texts of all rows.

Defined results: null, empty and blank texts and texts without letters get no
language and confidence 0; repeated rows give their rows each (``found`` gives
distinct ones); ties go to the language first in ``LANGUAGES``; without any
labelled row every text is of no language. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record

LANGUAGES = ("bg", "en", "ru", "mk", "de", "fr", "es")
_CYRILLIC = np.array([c in ("bg", "ru", "mk") for c in LANGUAGES])
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
#: Features are counted in so many buckets.
BUCKETS = 1 << 16
#: Cost of a change of language inside a sentence and after its end, in nats.
INSIDE, BETWEEN = 9.0, 3.5
#: A text or sentence of the sample leaves its stored label if another language leads by so many nats; a feature below this rate says little.
TRUST, RARE = 15.0, 3e-5
#: A word's score in the best language over the worst of its script, at most.
MOST = 4.0
#: Words of whole sentences that a language of a mixed text must have, letter words that a label must rest on.
SEGMENT_WORDS, LABEL_WORDS = 15, 8

#: Names of the languages besides codes and regions, fixed values.
NAMES = {
    "bg": "bul bulgarian български българский bulgarisch bulgare búlgaro bulgaro",
    "en": "eng english английски английский englisch anglais inglés ingles англиски",
    "ru": "rus russian руски русский russisch russe ruso",
    "mk": "mkd mac macedonian македонски македонский mazedonisch macédonien macedonio",
    "de": "deu ger german deutsch немски немецкий allemand alemán aleman германски",
    "fr": "fra fre french français francais френски французский französisch francés frances француски",
    "es": "spa spanish español espanol испански испанский spanisch espagnol castellano шпански",
}
_CODES = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}

SPANS = "doc_id bigint, lang string, confidence double, letter_words int, segments array<struct<lang:string,words:int,sentences:int,start_word:int,end_word:int,confidence:double>>, whole array<struct<lang:string,words:int,confidence:double>>"
_SEGMENT = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("sentences", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("confidence", pa.float64())]))
_WHOLE = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())]))
_SPANS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("letter_words", pa.int32()), ("segments", _SEGMENT), ("whole", _WHOLE)])

_LETTERS = re.compile(r"[^\W\d_]+").findall
_END = re.compile(r"[.!?…][\"'”“’»)\]]*$").search


def named(label: str | None) -> str | None:
    """The code that a stored label stands for, in any spelling, or None."""
    text = (label or "").strip().casefold()
    return _CODES.get(text) or _CODES.get(re.split(r"[-_ (]", text, maxsplit=1)[0]) if text else None


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter triples of the words (with a blank at both ends) and of the
    words themselves, and where each word's begin."""
    codes = np.frombuffer(("".join([f" {w} " for w in words])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 2)))[:-1]
    h = codes.copy()
    h[:-1] += codes[1:] * np.uint64(0x9E3779B1)
    h[:-2] += codes[2:] * np.uint64(0x85EBCA77C2B2AE63)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    whole = np.add.reduceat(h ^ (h >> np.uint64(17)), begin) * np.uint64(0x94D049BB133111EB)
    # a word of n letters has n triples; the place after them is a blank that takes the word itself
    h[begin + lengths] = whole
    sizes = lengths + 1
    first = np.cumsum(sizes) - sizes
    at = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(first, sizes)
    return (h[at] >> np.uint64(48)).astype(np.int64), first


class Scores:
    """By bucket of a feature, the log of each language's share of its rates."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def fitted(counts: np.ndarray) -> "Scores":
        """What is as rare in all languages says nothing, however much text each has."""
        rate = counts / np.maximum(1.0, counts.sum(0)) + RARE
        return Scores(np.log(rate / rate.sum(1, keepdims=True)).astype(np.float32))

    def of(self, words: list[str]) -> np.ndarray:
        """Scores (words x languages); languages of another script are 2 * MOST below."""
        out = np.zeros((len(words), len(LANGUAGES)), np.float32)
        letters = ["".join(_LETTERS(w)).casefold() for w in words]
        at = [k for k, w in enumerate(letters) if w]
        if not at:
            return out
        own = [letters[k] for k in at]
        bucket, begin = _features(own)
        # a word's features aren't independent: they count as two
        size = np.diff(np.append(begin, len(bucket)))
        score = np.add.reduceat(self.table[bucket], begin) * (2 / size)[:, None]
        cyrillic = np.array(["Ѐ" <= w[0] <= "ԯ" for w in own])
        latin = np.array([w[0] < "ɐ" for w in own])
        allowed = np.where(cyrillic[:, None], _CYRILLIC, np.where(latin[:, None], ~_CYRILLIC, True))
        best = np.where(allowed, score, -np.inf).max(1, keepdims=True)
        score = np.where(allowed, np.maximum(score - best, -MOST), -2 * MOST)
        score[~(cyrillic | latin)] = 0
        out[at] = score
        return out


def _counts(texts, languages) -> np.ndarray:
    """Feature counts by language of (texts, numbers of their languages); -1 counts nowhere."""
    n = len(LANGUAGES)
    counts = np.zeros(BUCKETS * n)
    for at in range(0, len(texts), 2000):
        words, owner = [], []
        for text, language in zip(texts[at : at + 2000], languages[at : at + 2000]):
            if language >= 0:
                own = [x for w in text.split() if (x := "".join(_LETTERS(w)).casefold())]
                words += own
                owner += [language] * len(own)
        if words:
            bucket, first = _features(words)
            counts += np.bincount(bucket * n + np.repeat(owner, np.diff(np.append(first, len(bucket)))), minlength=BUCKETS * n)
    return counts.reshape(BUCKETS, n)


def fitted(rows: list[tuple[str, str]]) -> Scores:
    """Scores from (text, code) rows, of which a part may be wrong."""
    texts, labels = [t for t, _ in rows], [LANGUAGES.index(c) for _, c in rows]
    scores = Scores.fitted(_counts(texts, labels))
    # whole texts first, which takes wrong labels out, then sentences, as texts may hold several languages
    split = [(p, c) for t, c in zip(texts, labels) for p in re.split(r"(?<=[.!?…])\s+|\n+", t) if _LETTERS(p)]
    whole = [(t, c) for t, c in zip(texts, labels) if _LETTERS(t)]
    for n, (parts, stored) in enumerate([tuple(map(list, zip(*x))) for x in (whole, whole, split, split) if x]):
        words = [p.split() for p in parts]
        begin = np.concatenate(([0], np.cumsum([len(ws) for ws in words])[:-1]))
        sums = np.add.reduceat(scores.of([w for ws in words for w in ws]), begin)
        if n == 2:  # the labels that the whole texts were given
            at = {t: c for (t, _), c in zip(whole, known)}
            stored = [at[t] for t in texts if t in at for p in re.split(r"(?<=[.!?…])\s+|\n+", t) if _LETTERS(p)]
            base = stored
        known = (sums + np.eye(len(LANGUAGES))[base if n == 3 else stored] * TRUST).argmax(1).tolist()
        scores = Scores.fitted(_counts(parts, known))
    return scores


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample of labelled rows the scores are fitted on."""
    lang = F.lower(F.trim("lang"))
    labelled = documents.filter(F.col("doc_id").isNotNull() & F.substring_index(F.translate(lang, "_", "-"), "-", 1).isin(*_CODES))
    share = SAMPLE_ROWS / max(1, labelled.count())
    # rows below a hash bound, so that no task sends more than its part of the sample
    drawn = labelled.filter((F.xxhash64("doc_id") <= F.lit(int(min(1.0, share) * (1 << 64)) - (1 << 63) - 1)) & (F.length("text") <= SAMPLE_CHARS))
    rows = sorted(drawn.select("doc_id", "text", "lang").collect())
    return [(r.text, code) for r in rows if (code := named(r.lang))]


class _Words(dict):
    """Numbers of the words between white space; scored together when asked for."""

    def __init__(self, scores: Scores):
        self.scores, self.fresh = scores, []
        self.table = np.zeros((0, len(LANGUAGES)), np.float32)
        self.letter, self.ends = np.zeros(0, bool), np.zeros(0, bool)

    def __missing__(self, word):
        self[word] = found = len(self.table) + len(self.fresh)
        self.fresh.append(word)
        return found

    def settle(self):
        if self.fresh:
            self.table = np.concatenate((self.table, self.scores.of(self.fresh)))
            self.letter = np.concatenate((self.letter, [any(c.isalpha() for c in w) for w in self.fresh]))
            self.ends = np.concatenate((self.ends, [_END(w) is not None for w in self.fresh]))
            self.fresh = []


def labelled(texts: list[np.ndarray], table: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """The best language of each word of each text. All texts of the list move on by a word at a time."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order])
    n, most = len(texts), int(lengths[0]) if len(texts) else 0
    if not most:
        return [np.zeros(0, np.int8) for _ in texts]
    words = np.zeros((most, n), np.int32)
    cost = np.full((most, n), INSIDE, np.float32)
    for c, k in enumerate(order):
        words[: lengths[c], c] = texts[k]
        cost[1 : lengths[c], c][ends[k][: max(0, lengths[c] - 1)]] = BETWEEN
    back = np.zeros((most, n, len(LANGUAGES)), np.int8)
    own = np.arange(len(LANGUAGES), dtype=np.int8)
    value = table[words[0]].copy()
    active = np.searchsorted(-lengths, -np.arange(most), "left")  # texts longer than a position
    for t in range(1, most):
        m = int(active[t])
        v = value[:m]
        best = v.argmax(1)
        change = v[np.arange(m), best] - cost[t, :m]
        stay = v >= change[:, None]
        back[t, :m] = np.where(stay, own, best[:, None])
        value[:m] = np.where(stay, v, change[:, None]) + table[words[t, :m]]
    path = np.zeros((most, n), np.int8)
    state = value.argmax(1)
    for t in range(most - 1, -1, -1):
        m = int(active[t])
        path[t, :m] = state[:m]
        if t:
            state[:m] = back[t, np.arange(m), state[:m]]
    out = [np.zeros(0, np.int8)] * n
    for c, k in enumerate(order):
        out[k] = path[: lengths[c], c]
    return out


def _confidence(scores: np.ndarray, lang: int) -> float:
    """Probability of the language over the stretch, tempered by a word's share."""
    total = scores.sum(0) / max(1.0, len(scores) ** 0.5)
    e = np.exp(total - total.max())
    return float(e[lang] / e.sum())


def _described(ident, numbers, path, ends, vocabulary):
    letter = vocabulary.letter[numbers]
    if len(path) and path[0] == path[-1] and (path == path[0]).all() and letter.any():
        # one language throughout
        g = int(path[0])
        lang, sure, sentences = LANGUAGES[g], _confidence(vocabulary.table[numbers], g), int(ends[:-1].sum()) + 1
        whole = [{"lang": lang, "words": len(path), "confidence": sure}]
        return ident, lang, sure, int(letter.sum()), [{**whole[0], "sentences": sentences, "start_word": 0, "end_word": len(path)}], whole
    count = np.bincount(path[letter], minlength=len(LANGUAGES))
    if not letter.any():
        return ident, None, 0.0, 0, [], []
    table = vocabulary.table[numbers]
    main = int(count.argmax())
    last = np.flatnonzero(ends)
    last = last if len(last) and last[-1] == len(numbers) - 1 else np.append(last, len(numbers) - 1)
    begin = np.concatenate(([0], last[:-1] + 1))
    # sentences with one language among their letter words; a sentence without such is no stretch's
    lo = np.minimum.reduceat(np.where(letter, path, 99), begin)
    hi = np.maximum.reduceat(np.where(letter, path, -1), begin)
    one = (lo == hi) & (hi >= 0)
    size = last - begin + 1
    whole = []
    for g in range(len(LANGUAGES)):
        if (n := int(size[one & (hi == g)].sum())):
            at = np.repeat(one & (hi == g), size)
            whole.append({"lang": LANGUAGES[g], "words": n, "confidence": _confidence(table[at], g)})
    edge = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    segments = []
    for a, b in zip(edge, np.append(edge[1:], len(path))):
        if letter[a:b].any():
            g = int(path[a])
            segments.append({"lang": LANGUAGES[g], "words": int(b - a), "sentences": int(((begin >= a) & (last < b)).sum()), "start_word": int(a), "end_word": int(b), "confidence": _confidence(table[a:b], g)})
    return ident, LANGUAGES[main], _confidence(table[letter], main) if len(segments) < 2 else float(count[main] / count.sum()), int(letter.sum()), segments, whole


def _spans(rows, vocabulary):
    ids, numbers, ends = [], [], []
    for ident, text in rows:
        own, stop = [], []
        for line in (text or "").splitlines():
            words = line.split()
            if words:
                own += [vocabulary[w] for w in words]
                stop.append(len(own) - 1)
        ids.append(ident)
        numbers.append(np.array(own, np.int64))
        ends.append(stop)
    vocabulary.settle()
    closed = []
    for own, stop in zip(numbers, ends):
        end = vocabulary.ends[own]
        end[stop] = True
        closed.append(end)
    paths = labelled(numbers, vocabulary.table, closed)
    return [_described(*x, vocabulary) for x in zip(ids, numbers, paths, closed)]


def _rows(documents, scores, schema, plain, shape):
    if scores is None:
        rows = sample(documents)
        scores = fitted(rows) if rows else Scores(np.zeros((BUCKETS, len(LANGUAGES)), np.float32))
    sent = documents.sparkSession.sparkContext.broadcast(scores.table)  # 1.8 MB at any size

    def run(batches):
        vocabulary = _Words(Scores(sent.value))
        for b in pieces(batches, rows=1000, size=3 << 20):
            if len(vocabulary) > 200_000:
                vocabulary = _Words(Scores(sent.value))
            got = shape(_spans(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), vocabulary), b.column(2).to_pylist())
            yield record(schema, *(map(list, zip(*got)) if got else [[] for _ in schema]))

    return documents.select("doc_id", "text", "lang").mapInArrow(run, plain)


def languages(documents: DataFrame, scores: Scores | None = None) -> DataFrame:
    """SPANS: language and confidence of each document, its segments, and the words of whole sentences by language."""
    return _rows(documents, scores, _SPANS, SPANS, lambda spans, _: spans)


_FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("lang", pa.string())])


def _differing(spans, labels):
    out = []
    for (ident, main, _, letters, _, whole), label in zip(spans, labels):
        if ident is None or main is None:
            continue
        if letters >= LABEL_WORDS and named(label) != main:
            out.append((ident, "label", main))
        large = [x["lang"] for x in whole if x["words"] >= SEGMENT_WORDS]
        if len(large) > 1:
            out += [(ident, "segment", x) for x in large]
    return out


def found(documents: DataFrame, scores: Scores | None = None) -> DataFrame:
    """(doc_id, kind, lang): labels that are missing or wrong with the right one, and
    each language of the documents that hold several."""
    return _rows(documents, scores, _FOUND, "doc_id bigint, kind string, lang string", _differing)
