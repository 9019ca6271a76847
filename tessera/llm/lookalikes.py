"""Problem 3: texts that read alike but are stored in different characters.

Words that read alike share a skeleton: the first of its look-alike letters for each
letter, in plain forms, without characters of no width. A word with a letter that only
one script has can be spelled in one way only, in that script, which a table gives; it
needs no other word to be known. A word made of look-alikes alone (``со``, ``CO``) may
be meant in several scripts: the distinct ones of all texts are the vocabulary, counted
before any shuffle and sorted by skeleton. For each run of it a trie of the clearly
spelled words is built (composed, of one script, without characters of no width or wide
forms), and every word of the run is led through the trie by a weighted edit automaton:
a look-alike letter and a wide form cost nothing, a character without width is passed
for nothing, any other difference costs 1, and a word may spend ``BUDGET`` (nothing,
since all that can be seen counts). Of the spellings it arrives at, the most frequent
one becomes the form of the run. A word that arrives at none is spelled by table.

The texts themselves are never moved by word: the runs whose form isn't the table's
(few, as they are made of some 30 letters) are sent to all tasks where they are at most
``SPELLINGS`` in number and ``SPELLING_BYTES`` in size, and otherwise joined to the
texts that hold such words.

Blanks of any kind between words become one blank, those at either end nothing.

Defined results: null texts stay null, blank ones become empty; a question with a
null among its texts is equal to no other. Repeated rows count once. Ties between
spellings go to the smaller by code point. Other columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record
from ..sources.tables import settled

#: What a word may differ by from its spelling.
BUDGET = 0.0
#: Letters that look alike, Cyrillic first where there is one. Fixed values.
ALIKE = "аa еe оoο рp сcϲ уy хx ѕs іi јj һh ԁd ԛq ԝw νv АAΑ ВBΒ ЕEΕ ЅS ІIΙ ЈJ КKΚ МMΜ НHΗ ОOΟ РPΡ СCϹ ТTΤ ХXΧ ΝN ΖZ ΥY".split()
#: Hyphens that look alike. Fixed values.
_HYPHENS = "‐‑"
#: Parts into which the rows of one key are dealt, however many they are.
SALTS = 8
#: Most spellings, and bytes of them, that are sent to all tasks; more are joined.
SPELLINGS, SPELLING_BYTES = 100_000, 16 << 20

_CLASS = {c: group[0] for group in ALIKE for c in group}
_IN = {script: {group[0]: c for group in ALIKE for c in group if script in unicodedata.name(c)} for script in ("LATIN", "GREEK")}


def without_width(c: str) -> bool:
    """Whether a character shows nothing and takes no room."""
    return unicodedata.category(c) in ("Cf", "Cc") and not c.isspace() or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️"


def _narrow(c: str) -> str:
    """A wide, narrow or styled form as the plain character."""
    form = unicodedata.decomposition(c)
    return unicodedata.normalize("NFKC", c) if form.startswith(("<wide>", "<narrow>", "<font>")) else "-" if c in _HYPHENS else c


def composed(word: str) -> str:
    """A word without characters of no width, in plain forms, with its accents joined to their letters."""
    if word.isascii():
        return word if word.isprintable() else "".join(c for c in word if not without_width(c))
    kept = "".join(_narrow(c) for c in word if not without_width(c))
    # an accent on a look-alike letter is joined to the letter it looks like
    if not unicodedata.is_normalized("NFC", kept):
        kept = unicodedata.normalize("NFC", kept)
    if any(unicodedata.combining(c) for c in kept):
        kept = unicodedata.normalize("NFC", "".join(_CLASS.get(c, c) for c in kept))
    return kept


def skeleton(word: str) -> str:
    """The word in the first of its look-alike letters: the same for words that read alike."""
    return "".join(_CLASS.get(c, c) for c in composed(word))


def _scripts(word: str) -> set[str]:
    return {unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha()}


def clear(word: str) -> bool:
    """Whether a word can be a spelling: composed, without characters of no width, of one script."""
    return composed(word) == word and len(_scripts(word)) < 2


def unclear(plain: str) -> bool:
    """Whether a skeleton is made of look-alike letters alone, so that several scripts may be meant."""
    letters = [c for c in plain if c.isalpha()]
    return bool(letters) and all(c in _CLASS for c in letters)


def by_table(word: str) -> str:
    """The spelling of a word that no clear one is found for: alike words give the same. Where a letter
    belongs to one script only, it is the one clear spelling that the word can have."""
    return _in_script(skeleton(word))


def _in_script(plain: str) -> str:
    own = _scripts("".join(c for c in plain if c not in _CLASS))
    to = _IN.get(next(iter(own)), {}) if len(own) == 1 else {}
    return "".join(to.get(c, c) for c in plain)


class Trie:
    """Spellings with their frequencies, as nested dictionaries."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = max(node.get("", (0, ""))[0], count), word

    def spellings(self, word: str, budget: float = BUDGET) -> list[tuple[float, int, str]]:
        """(cost, count, spelling) of those the automaton arrives at from ``word``."""
        states = {id(self.root): (0.0, self.root)}

        def keep(new, node, cost):
            if cost <= budget and cost < new.get(id(node), (9e9,))[0]:
                new[id(node)] = cost, node

        def unread(states):  # letters of the spelling that the word lacks
            todo = list(states.values())
            while todo and budget > 0:
                cost, node = todo.pop()
                for c, child in node.items():
                    if c and cost + 1 <= budget and cost + 1 < states.get(id(child), (9e9,))[0]:
                        states[id(child)] = cost + 1, child
                        todo.append(states[id(child)])
            return states

        states = unread(states)
        for c in composed(word):
            plain, new = _CLASS.get(c, c), {}
            for cost, node in states.values():
                keep(new, node, cost + 1)
                for edge, child in node.items():
                    if edge:
                        keep(new, child, cost + (_CLASS.get(edge, edge) != plain))
            states = unread(new)
            if not states:
                return []
        return [(cost, *node[""]) for cost, node in states.values() if "" in node]


_FORMS = pa.schema([("word", pa.string()), ("form", pa.string()), ("skeleton", pa.string())])


def _spelled(run: list[tuple[str, int, str]]):
    """(word, form, skeleton) of a run of the vocabulary (word, count, skeleton) that holds all words alike to any of its own."""
    trie = Trie()
    for word, count, _ in run:
        if clear(word):
            trie.add(word, count)
    for word, _, plain in run:
        found = trie.spellings(word)
        yield word, min(found, key=lambda x: (x[0], -x[1], x[2]))[2] if found else _in_script(plain), plain


def _forms(batches):
    run, last = [], None
    for b in pieces(batches, rows=10_000):
        for word, plain, count in zip(*(c.to_pylist() for c in b.columns)):
            if plain != last and len(run) >= 10_000:
                yield record(_FORMS, *map(list, zip(*_spelled(run))))
                run = []
            run.append((word, count, plain))
            last = plain
    if run:
        yield record(_FORMS, *map(list, zip(*_spelled(run))))


_COUNTED = pa.schema([("word", pa.string()), ("skeleton", pa.string()), ("n", pa.int64())])
_COUNTS = "word string, skeleton string, n bigint"


def _led(counted: DataFrame) -> DataFrame:
    """(word, form, skeleton) of a vocabulary (word, skeleton, n), by the tries of its runs."""
    return counted.repartition("skeleton").sortWithinPartitions("skeleton").select("word", "skeleton", "n").mapInArrow(_forms, "word string, form string, skeleton string")


def forms(words: DataFrame) -> DataFrame:
    """(word, form) of each distinct word of (word)."""

    def keyed(batches):
        for b in pieces(batches, rows=10_000):
            yield record(_COUNTED, b.column(0), [skeleton(w) for w in b.column(0).to_pylist()], b.column(1))

    counted = words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n")
    return _led(counted.mapInArrow(keyed, _COUNTS)).select("word", "form")


#: Words of Cyrillic letters and signs, and a letter that only Cyrillic (or only Latin, among ASCII) has.
_PLAIN = re.compile("[!-@\\[-`{-~Ѐ-џ„“”«»–—№°…]+").fullmatch
_SURE = re.compile("[" + "".join(c for c in map(chr, [*range(0x400, 0x460), *range(65, 91), *range(97, 123)]) if c not in _CLASS) + "]").search


class _Table(dict):
    """From a word between blanks to (spelling by table, skeleton where several scripts may be meant)."""

    def __missing__(self, word):
        if _SURE(word) and (_PLAIN(word) or word.isascii() and word.isprintable()):
            found = word, None
        else:
            plain = skeleton(word)
            found = _in_script(plain), plain if unclear(plain) else None
        if len(self) < 300_000:
            self[word] = found
        return found


class _Spelling(dict):
    """From a word between blanks to its form: a chosen one of its run, or the table's."""

    def __init__(self, chosen: dict):
        self.chosen, self.table = chosen, _Table()

    def __missing__(self, word):
        form, plain = self.table[word]
        found = self.chosen.get(plain, form) if plain is not None else form
        if len(self) < 300_000:
            self[word] = found
        return found


def _one(text: str | None, spelling) -> str | None:
    return None if text is None else " ".join(filter(None, map(spelling.__getitem__, text.split())))


def _vocabulary(batches):
    """Counts of the words of (texts) that several scripts may be meant by, one row for each in a batch."""
    table = _Table()
    for b in pieces(batches, rows=20_000):
        seen = Counter()
        for texts in b.column(0).to_pylist():
            for text in texts or ():
                if text:
                    seen.update(text.split())
        own = [(w, plain, n) for w, n in seen.items() if (plain := table[w][1]) is not None]
        yield record(_COUNTED, *(map(list, zip(*own)) if own else ([], [], [])))


def chosen(rows: DataFrame) -> DataFrame:
    """(skeleton, form) of the runs of the vocabulary of rows (texts array<string>) whose form isn't the table's."""
    counted = rows.select("texts").mapInArrow(_vocabulary, _COUNTS).groupBy("word", "skeleton").agg(F.sum("n").alias("n"))
    return _led(counted).mapInArrow(_untabled, "skeleton string, form string").groupBy("skeleton").agg(F.min("form").alias("form"))


def _untabled(batches):
    """(skeleton, form) of the forms (word, form, skeleton) that aren't the table's."""
    for b in pieces(batches, rows=10_000):
        own = {(plain, form) for form, plain in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if form != _in_script(plain)}
        yield pa.RecordBatch.from_pydict({"skeleton": [x for x, _ in own], "form": [y for _, y in own]}, pa.schema([("skeleton", pa.string()), ("form", pa.string())]))


def _digest(texts: list[str | None]) -> bytes:
    """A hash of 128 bits of texts, which may be null."""
    return xxhash.xxh3_128_digest("".join("-" if t is None else f"{len(t)}:{t}" for t in texts).encode("utf-8", "surrogatepass"))


def _halves(digests: list[bytes]) -> tuple[list[int], list[int]]:
    return [int.from_bytes(d[:8], "big", signed=True) for d in digests], [int.from_bytes(d[8:], "big", signed=True) for d in digests]


def respelled(rows: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` gives for batches of rows (id, texts): function of (ids, texts, forms) to columns in the
    order of ``schema``, where forms are the texts in one consistent form.

    rows is read twice."""
    found = settled(chosen(rows), "spellings")
    size = found.agg(F.count("*").alias("n"), F.sum(F.octet_length("skeleton") + F.octet_length("form")).alias("bytes")).first()
    arrow = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def made(ids, texts, spelled):
        return record(arrow, *make(ids, texts, [None if t is None else [_one(x, s) for x in t] for t, s in zip(texts, spelled)]))

    if size.n <= SPELLINGS and (size.bytes or 0) <= SPELLING_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in found.collect()})

        def run(batches):
            spelling = _Spelling(sent.value)
            for b in pieces(batches):
                yield made(*(b.column(i).to_pylist() for i in (0, 1)), [spelling] * b.num_rows)

        return rows.select("id", "texts").mapInArrow(run, schema)

    # more of them: each row meets those of its own words, by a hash of the row
    held = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("skeleton", pa.string())])
    hashed = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.string()), ("texts", pa.list_(pa.string()))])

    def holds(batches):
        table = _Table()
        for b in pieces(batches):
            ids, texts = (c.to_pylist() for c in b.columns)
            x, y = _halves([_digest([i, *(t or ())]) for i, t in zip(ids, texts)])
            own = [(p, q, s) for p, q, t in zip(x, y, texts) for s in {table[w][1] for z in t or () if z for w in z.split()} if s is not None]
            yield record(held, *(map(list, zip(*own)) if own else ([], [], [])))

    def keyed(batches):
        for b in pieces(batches):
            ids, texts = (c.to_pylist() for c in b.columns)
            yield record(hashed, *_halves([_digest([i, *(t or ())]) for i, t in zip(ids, texts)]), ids, texts)

    def joined(batches):
        table = _Table()
        for b in pieces(batches):
            ids, texts, own = (c.to_pylist() for c in b.columns)
            spelled = []
            for x in own:
                spelling = _Spelling({e["skeleton"]: e["form"] for e in x or ()})
                spelling.table = table
                spelled.append(spelling)
            yield made(ids, texts, spelled)

    parts = found.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    words = rows.select("id", "texts").mapInArrow(holds, "a bigint, b bigint, skeleton string").distinct().withColumn("part", F.pmod("a", F.lit(SALTS)).cast("int"))
    own = words.join(parts, ["skeleton", "part"]).groupBy("a", "b").agg(F.collect_list(F.struct("skeleton", "form")).alias("own"))
    every = rows.select("id", "texts").mapInArrow(keyed, "a bigint, b bigint, id string, texts array<string>")
    return every.join(own, ["a", "b"], "left").select("id", "texts", "own").mapInArrow(joined, schema)


def question_rows(questions: DataFrame) -> DataFrame:
    """(id, texts) of the questions: the question and its answers."""
    texts = F.concat(F.array("question"), F.coalesce("answers", F.array().cast("array<string>")))
    return questions.select("id", "question", "answers").filter("id IS NOT NULL").select("id", texts.alias("texts"))


def one_form_questions(rows: DataFrame) -> DataFrame:
    """(id, question, answers) in one consistent form."""
    return respelled(rows, lambda ids, _, forms: (ids, [f[0] for f in forms], [f[1:] for f in forms]), "id string, question string, answers array<string>").distinct()


def question_keys(rows: DataFrame) -> DataFrame:
    """(id, a, b, stored): hashes of the texts in one form, of 128 bits, and of the texts as stored, of those
    questions that may equal another."""

    def make(ids, texts, forms):
        kept = [k for k, t in enumerate(texts) if len(t) > 1 and None not in t]
        stored = [xxhash.xxh3_64_intdigest(_digest(texts[k])) - (1 << 63) for k in kept]
        return [ids[k] for k in kept], *_halves([_digest(forms[k]) for k in kept]), stored

    return respelled(rows, make, "id string, a bigint, b bigint, stored bigint")


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))


def alike_questions(rows: DataFrame) -> DataFrame:
    """(id_a, id_b): different ids whose texts read the same while one is stored in differing characters.

    Only texts that are stored in several ways meet: first these ways, each once, then the ids of both, so
    that equal copies of a question, however many, are never held against each other.
    """
    keyed = settled(question_keys(rows), "question-keys")
    several = keyed.groupBy("a", "b").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).filter("x <> y").select("a", "b")
    placed = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    near = settled(placed.join(_parts(several), ["a", "b", "part"], "left_semi").distinct(), "question-copies")
    ways = near.select("a", "b", "stored").distinct()
    pairs = ways.withColumnRenamed("stored", "stored_x").join(ways.withColumnRenamed("stored", "stored_y"), ["a", "b"]).filter("stored_x < stored_y")
    left = near.select("a", "b", F.col("stored").alias("stored_x"), "part", F.col("id").alias("id_x")).join(_parts(pairs), ["a", "b", "stored_x", "part"])
    right = _parts(near.select("a", "b", F.col("stored").alias("stored_y"), F.col("id").alias("id_y")))
    met = left.join(right, ["a", "b", "stored_y", "part"]).filter("id_x <> id_y")
    return met.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()
