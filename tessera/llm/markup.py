"""Problem 5: markup residue of page texts.

Two stages. First each page is cleaned by itself: HTML, wiki markup, Markdown and
LaTeX become plain text in one form, in which headings are ``== x ==`` lines, list
items begin with ``- ``, table rows are ``| a | b |`` lines, code stands between
lines of three backticks and formulas between dollar signs. The kinds of markup a
page held are noted on the way.

Then the cleaned token streams of a host (``source_file``) are searched for long
runs that stand in pages of different titles, as a suffix array would: suffixes with
an equal start of ``RUN`` words lie side by side in it, so what is looked for are the
groups of suffixes by host and first ``RUN`` words that hold several titles. The array
is never built in one place, as a host may hold any share of the pages: the suffixes
are grouped by hash, and partial groups are combined before the shuffle. So that not
all of them need be shuffled, each has a seed, the smallest hash of ``SEED`` words in
its first ``RUN``: equal starts have equal seeds, and neighbours mostly share theirs.
The seeds are found while cleaning. Only suffixes whose seed stands in pages of several
titles are grouped by their whole start. Every repeated run of ``RUN`` words and more is found and covered to both its
ends. Covered words are removed (not in headings or code), what is unique stays.
Copies of a page have its title and so don't make its text boilerplate.

Defined results: null content stays null with no kinds, blank content becomes empty;
pages without title count as pages of one title, without host as of one host;
repeated rows of one page_id count once; other columns aren't read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record
from ..sources.tables import settled

#: Words of a suffix's start, and of the seeds in it.
RUN, SEED = 16, 12
#: Parts in which the places of a repeated run are joined.
SALTS = 8
#: Bits of a hash that is only a filter, and bits of the sets that are broadcast, by which what isn't in them is kept out of shuffles.
SHORT, BITS = 48, 1 << 26

#: Element names of HTML. Fixed values.
_ELEMENTS = "a abbr address article aside audio b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
_TAG = r"</?(?:" + "|".join(sorted(_ELEMENTS.split(), key=len, reverse=True)) + r")(?![\w:-])"
_REF = r"</?(?:ref|references)(?![\w:-])"

def _at(pattern: str):
    return re.compile(pattern, re.I | re.M).match


#: What makes a kind of markup, by the sign at which it begins.
_SIGNS_OF = {
    "<": [("html", _at(rf"{_TAG}|<!--|<!doctype")), ("wiki", _at(rf"{_REF}|</?(?:nowiki|gallery)\b"))],
    "&": [("html", _at(r"&(?:#\d+|#x[0-9a-f]+|[a-z][a-z0-9]{1,30});"))],
    "-": [("html", _at("-->"))],
    "{": [("wiki", _at(r"\{\{|\{\|"))],
    "'": [("wiki", _at(r"(?<![\d'])''+(?=[^\s'])|(?<=[^\W\d])''+"))],
    "|": [("wiki", _at(r"\|\}(?!\})|^\|-+[ \t]*$")), ("markdown", _at(r"\|[ \t]*:?-{3,}:?[ \t]*(?:\||$)"))],
    "[": [("wiki", _at(r"\[\[|\[(?:https?:)?//[^\s\]]+[ \]]")), ("markdown", _at(r"\[[^\[\]\n]*+\]\([^\s)]|(?<!\S)\[[^\[\]\n]++\]:[ \t]+\S|(?<!\[)\[[^\[\]\n]++\]\[[^\[\]\n/:]*+\](?!\])"))],
    "!": [("markdown", _at(r"!\["))],
    "#": [("markdown", _at(r"(?<!\S)#{1,6}[ \t]+(?=[^\W\d_]|\*|`)"))],
    "*": [("markdown", _at(r"\*\*(?=[^\s*])|(?<=[^\s*])\*\*(?!\*)|(?<![\w*])\*(?=[^\s*])[^*\n]*+(?<=[^\s*])\*(?![\w*])"))],
    "_": [("markdown", _at(r"(?<!\w)__(?=[^\W_])|(?<=[^\W_])__(?!\w)|(?<![\w_])_(?=[^\s_])[^_\n]*+(?<=[^\s_])_(?![\w_])"))],
    "~": [("markdown", _at(r"~~(?=[^\s~])|(?<=[^\s~])~~"))],
    "`": [("markdown", _at(r"```|(?<!\w)`[^`\n]++`"))],
    "\\": [("latex", re.compile(r"(?<![\w:\\])\\(?:[a-zA-Z]{2,}|[a-zA-Z](?=[{_^])|[(\[])|(?<=\w)\\(?:begin|end|cite|ref|frac|emph|textbf|item)\b").match)],
    "$": [("latex", _at(r"\$\$|(?<![\w$])\$(?=[^\s$])(?=[^$\n]*[\\^_=+{])[^$\n]*+(?<=[^\s$])\$(?![\w$])"))],
}
KINDS = ("html", "wiki", "markdown", "latex")
#: All signs at once; a hyphen only counts before another.
_SIGN = re.compile(r"[<&{'|\[!#*_~`\\$]|--")
_ANY = re.compile(r"[<>&\[{}'*_`#~|\\$]")


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in ``text``, closed or not, in the order of KINDS."""
    found: set[str] = set()
    for m in _SIGN.finditer(text or ""):
        for kind, match in _SIGNS_OF[m[0][0]]:
            if kind not in found and match(text, m.start()):
                found.add(kind)
                if len(found) == len(KINDS):
                    return list(KINDS)
    return [k for k in KINDS if k in found]


# Passes of the cleaning, in order; what is kept as it is (code, formulas) is set aside first. What begins
# and doesn't end loses its own signs only, never the text behind it.
_VALUED = r"""(?:\s*+[a-zA-Z_:@][\w:.-]*+\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s<>"']++))*+"""
_ATTRIBUTES = r"""(?:\s*+[a-zA-Z_:@][\w:.-]*+(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s<>"']++))?+)*+\s*+/?"""


def _tag(names: str) -> str:
    """A pattern for whole tags of these names."""
    return rf"<(?:{names})(?![\w:-]){_ATTRIBUTES}>"


_FENCE = re.compile(r"```[^\S\n]*([\w+-]*)[^\S\n]*\n?(.*?)```", re.S)
_PRE = re.compile(rf"{_tag('pre')}\s*(?:{_tag('code')})?((?:(?!<pre\b).)*?)(?:</code\s*>)?\s*</pre\s*>", re.S | re.I)
_CODE = re.compile(rf"{_tag('code')}((?:(?!<code\b).)*?)</code\s*>", re.S | re.I)
_TICK = re.compile(r"(?<!\w)`([^`\n]+)`")
_FORMULAS = [
    (r"\end{", re.compile(r"\\begin\{(equation|align|gather|math|displaymath)\*?\}(?P<x>(?:(?!\\begin\{).)*?)\\end\{\1\*?\}", re.S)),
    ("$$", re.compile(r"\$\$(?P<x>[^$]+)\$\$")),
    (r"\)", re.compile(r"\\\((?P<x>(?:(?!\\\()[^\n])+?)\\\)")),
    (r"\]", re.compile(r"\\\[(?P<x>(?:(?!\\\[).)+?)\\\]", re.S)),
    ("$", re.compile(r"(?<![\w$])\$(?=[^\s$])(?=[^$\n]*[\\^_=+{])(?P<x>[^$\n]*+)(?<=[^\s$])\$(?![\w$])")),
]
_OPEN_FORMULA = re.compile(r"\$\$|\\[()\[\]]")
_COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->", re.S)
_SCRIPT = re.compile(rf"{_tag('(?P<n>script|style)')}(?:(?!<(?P=n)\b).)*?</(?P=n)\s*>", re.S | re.I)
_NOTE = re.compile(rf"<ref(?![\w:-])(?:{_VALUED})\s*/>|{_tag('ref')}(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_OPEN_NOTE = re.compile(rf"</?(?:references|ref)(?![\w:-])(?:{_ATTRIBUTES}>|{_VALUED})|<!--|-->", re.I)
_DEFINITION = re.compile(r"(?<!\S)\[[^\[\]\n]+\]:[ \t]+(?:<[^<>\s]+>|\S*(?:/|#|\.\w)\S*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?")
_BRACES = re.compile(r"\{\{|\}\}")
_OPEN_TEMPLATE = re.compile(r"\{\{(?:[^\s{}|]+(?: [^\s{}|]+)*\s*\|)?")
_FILE = r"\[\[\s*(?:file|image|файл|картинка|category|категория|категории)\s*:"
_FILES = re.compile(_FILE + r"[^\[\]]*+(?:\[\[[^\[\]]*+\]\][^\[\]]*+)*+\]\]", re.I)
_OPEN_FILE = re.compile(_FILE + r"(?:\s*[^\[\]|\n]*?\.(?:jpe?g|png|svg|gif|tiff?|webp|ogg|pdf)\b(?:\|(?:мини|мини картинка|ляво|дясно|център|рамка|thumb|frame|left|right|center|\d+px)(?=\|))*)?", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_OPEN_LINK = re.compile(r"\[\[(?:([^\[\]|\n]*)\|)?")
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+[ \t]*([^\]\n]*)\]?")
_WIKI_TABLE = re.compile(r"\{\|(?:(?!\{\|).)*?\|\}", re.S)
_OPEN_TABLE = re.compile(rf"\{{\|{_VALUED}|^[ \t]*\|(?:\}}|-+){_VALUED}[ \t]*$", re.M)
_ROW_START = re.compile(rf"\n\s*\|-+{_VALUED}|\s\|-\s")
_MD_RULE = re.compile(r"(?<=\|)[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\](?:\([^\s)]*(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])")
_MD_HEAD = re.compile(r"^[ \t]*(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)
_MD_HEAD_INLINE = re.compile(r"(?<!\S)#{1,6}[ \t]+(?=[^\W\d_])")
_EMPHASIS = [(re.compile(r"'{2,5}"), ""), *((re.compile(rf"{x}(?=\S)((?:(?!{x}).)+)(?<=\S){x}"), r"\1") for x in (r"\*\*", "__", "~~")), (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"), r"\1"), (re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])"), r"\1"), (re.compile(r"\*\*|~~"), "")]
_TEX_HEAD = re.compile(r"\\(?:chapter|(?:sub)*section)\*?\{([^{}\n]*)\}")
_TEX_ITEM = re.compile(r"[ \t]*\\item\b[ \t]*")
_TEX_ENV = re.compile(r"\\(?:begin|end)\{(?:[a-zA-Z]+\*?\}?)?")
_TEX_NOTE = re.compile(r"~?\\(?:cite|ref|label|footnote)\w*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_TEX_SI = re.compile(r"\\SI\{([^{}\n]*)\}\{([^{}\n]*)\}")
_TEX_PARTS = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")
_TEX_COMMAND = re.compile(r"(?<![\w:])\\[a-zA-Z]{2,}\*?[ \t]?")
#: LaTeX commands that stand for a sign. Fixed values.
_SIGNS = {"percent": "%", "degree": "°", "celsius": "°C", "metre": "m", "kilo": "k", "meter": "m", "square": "²", "cubic": "³", "per": "/", "second": "s", "watt": "W"}
_H = re.compile(rf"{_tag('h(?P<n>[1-6])')}(?P<x>(?:(?!<h[1-6]\b).)*?)</h(?P=n)\s*>", re.S | re.I)
_CELL = re.compile(_tag("t[hd]"), re.I)
_ROW = re.compile(_tag("tr"), re.I)
_ROW_END = re.compile(rf"</tr\s*>|{_tag('table|caption')}|</(?:table|caption)\s*>", re.I)
_ITEM = re.compile(_tag("li"), re.I)
_BLOCKS = "p|div|ul|ol|dl|dd|dt|blockquote|section|article|header|footer|nav|aside|main|body|html|head|figure|form|hr|pre|br|h[1-6]"
_BLOCK = re.compile(rf"{_tag(_BLOCKS)}|</(?:{_BLOCKS})\s*>", re.I)
_INLINE = re.compile(rf"{_TAG}(?:{_ATTRIBUTES}>|{_VALUED})", re.I)
_HEADING = re.compile(r"^[ \t]*={2,6}[^=\n].*?={2,6}[ \t]*$")


def _wiki_rows(m: re.Match) -> str:
    out = []
    for row in _ROW_START.split(m.group().removeprefix("{|").removesuffix("|}")):
        cells = [c.strip() for c in re.split(r"\|\||!!|(?:^|\n|(?<=\s))[|!](?!\})", row) if c.strip()]
        if cells and re.search(r"\b\w+\s*=\s*[\"']", cells[0]):
            cells = [x for x in [re.sub(r"\b\w+\s*=\s*\"[^\"]*\"", "", cells[0]).strip(), *cells[1:]] if x]
        if cells:
            out.append("| " + " | ".join(cells) + " |")
    return "\n" + "\n".join(out) + "\n"


def _without_templates(text: str) -> str:
    """Without closed templates, however deeply they are nested."""
    out, open_, at = [], [], 0
    spans: list[tuple[int, int]] = []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]


def _without_commands(text: str) -> str:
    """LaTeX commands with an argument as the argument, however deeply they are nested."""
    out, open_, at = [], [], 0
    for m in _TEX_PARTS.finditer(text):
        command = len(m[0]) > 1
        if m[0] == "}":
            command = bool(open_) and open_.pop()
        else:
            open_.append(command)
        if command:
            out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


def cleaned(text: str) -> str:
    """``text`` without markup, in the form that the module's head describes."""
    if not _ANY.search(text):
        return text.strip()
    kept: list[str] = []

    def keep(block: str) -> str:
        kept.append(block)
        return f"\ue000{len(kept) - 1}\ue001"

    def restored(m: re.Match) -> str:
        return _KEPT.sub(restored, kept[int(m[1])])

    has = text.__contains__
    text = text.replace("\ue000", "").replace("\ue001", "").replace("\r", "")
    if has("```"):
        text = _FENCE.sub(lambda m: keep("\n```" + m[1] + "\n" + m[2].strip("\n") + "\n```\n"), text).replace("```", "")
    if has("<pre") or has("<PRE"):
        text = _PRE.sub(lambda m: keep("\n```\n" + html.unescape(_INLINE.sub("", m[1])).strip("\n") + "\n```\n"), text)
    if has("<code"):
        text = _CODE.sub(lambda m: keep("`" + html.unescape(m[1]) + "`"), text)
    if has("`"):
        text = _TICK.sub(lambda m: keep("`" + m[1] + "`"), text)
    if has("$") or has("\\"):
        for needed, p in _FORMULAS:
            if needed in text:
                text = p.sub(lambda m: keep("$" + " ".join(m["x"].split()) + "$"), text)
        text = _OPEN_FORMULA.sub("", text)
    if has("<") or has("-->"):
        text = _OPEN_NOTE.sub("", _NOTE.sub("", _SCRIPT.sub("", _COMMENT.sub("", text) if has("-->") else text)))
    if has("]:"):
        text = _DEFINITION.sub("", text)
    if has("{"):
        text = _OPEN_TEMPLATE.sub("", _without_templates(text))
        text = _OPEN_TABLE.sub("", _WIKI_TABLE.sub(_wiki_rows, text))
    if has("["):
        text = _OPEN_FILE.sub("", _FILES.sub("", text))
        text = _OPEN_LINK.sub(lambda m: m[1] + " " if m[1] else "", _LINK.sub(r"\1", text))
        text = _EXTERNAL.sub(r"\1", text)
        text = _MD_LINK.sub(r"\1", text)
    if has("|"):
        text = re.sub(r"\n[ \t]*\n", "\n\n", _MD_RULE.sub("\n", text).replace("|\n", "|\n")).replace("|\n\n|", "|\n|")
    if has("#"):
        text = _MD_HEAD.sub(lambda m: f"{'=' * max(2, len(m[1]))} {m[2]} {'=' * max(2, len(m[1]))}", text)
        text = _MD_HEAD_INLINE.sub("", text)
    if has("\\") or has("~"):
        text = _TEX_HEAD.sub(r"\n== \1 ==\n", text)
        text = _TEX_ITEM.sub("\n- ", text)
        text = _TEX_ENV.sub("\n", text)
        text = _TEX_NOTE.sub("", text)
        text = _TEX_SI.sub(lambda m: m[1] + " " + "".join(_SIGNS.get(x, x) for x in re.findall(r"[^\\]+", m[2])), text)
        text = _TEX_COMMAND.sub("", _without_commands(text))
        text = text.replace("~--", " – ").replace("~", "\u00a0") if "\\" in "".join(kept) or "~" in text and not has("~~") else text
    if has("<"):
        text = _H.sub(lambda m: f"\n== {' '.join(_INLINE.sub('', m['x']).split())} ==\n", text)
        text = _CELL.sub(" | ", text)
        text = _ROW.sub("\n", text)
        text = _ROW_END.sub(" |\n", text)
        text = re.sub(r"^[ \t]*\|[ \t]*$\n?", "", text, flags=re.M)
        text = _ITEM.sub("\n- ", text)
        text = _BLOCK.sub("\n", text)
        text = _INLINE.sub("", text)
    if has("&"):
        text = html.unescape(html.unescape(text)) if "&amp;" in text else html.unescape(text)
    for p, by in _EMPHASIS:
        text = p.sub(by, text)
    if kept:
        text = _KEPT.sub(restored, text)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"[ \t]{2,}", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_KEPT = re.compile("\ue000(\\d+)\ue001")
_CLEAN = pa.schema([("page_id", pa.int64()), ("host", pa.int64()), ("title", pa.int64()), ("kinds", pa.list_(pa.string())), ("text", pa.string()), ("seeds", pa.list_(pa.int64()))])
CLEAN = "page_id bigint, host bigint, title bigint, kinds array<string>, text string, seeds array<bigint>"


def _hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest("".join(c for c in (text or "").casefold() if c.isalnum()).encode("utf-8", "surrogatepass")) - (1 << 63)


def clean_pages(pages: DataFrame) -> DataFrame:
    """CLEAN: each page cleaned by itself, with the kinds of markup it held and the seeds of its suffixes."""

    def run(batches):
        hashes = _Hashes()
        for b in pieces(batches, rows=500, size=2 << 20):
            ids, titles, hosts, texts = (c.to_pylist() for c in b.columns)
            own, done = [_hash(h) for h in hosts], [None if t is None else cleaned(t) for t in texts]
            low, _, k, _ = suffixes(_words(done), own, hashes)
            edge = np.searchsorted(k, np.arange(len(ids) + 1))
            seeds = [np.unique(low[x:y] & ((1 << SHORT) - 1)) for x, y in zip(edge[:-1], edge[1:])]
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, seeds)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *seeds])))
            yield record(_CLEAN, ids, own, [_hash(t) for t in titles], [kinds(t) for t in texts], done, held)

    return pages.select("page_id", "title", "source_file", "content").filter("page_id IS NOT NULL").mapInArrow(run, CLEAN)


_STARTS = pa.schema([("start", pa.int64()), ("title", pa.int64()), ("page_id", pa.int64()), ("place", pa.int32())])


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word):
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 300_000:
            self[word] = found
        return found


def suffixes(texts: list[list[str]], hosts: list[int], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, hash of the first RUN words with the host, number of the text, position) of all
    suffixes of RUN words and more of texts (as words)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    n = total - RUN + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    one = np.fromiter((hashes[w] for t in texts for w in t), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h = np.array([x & (1 << 64) - 1 for x in hosts], np.uint64)[owner[: total - SEED + 1]]
    low = h
    for k in range(RUN):
        if k == SEED:
            low, h = h, h[:n].copy()
        h = (h ^ one[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    wide, whole = 1, RUN - SEED + 1
    while wide < whole:  # minimum of the RUN - SEED + 1 hashes of SEED words
        step = min(wide, whole - wide)
        low = np.minimum(low[:-step], low[step:])
        wide += step
    at = np.flatnonzero(place[:n] + RUN <= lengths[owner[:n]])
    return low[at].view(np.int64), h[at].view(np.int64), owner[at], place[at]


def _words(texts: list) -> list[list[str]]:
    return [(t or "").casefold().split() for t in texts]


def _several(found: DataFrame) -> DataFrame:
    """(start): those that stand in pages of several titles."""
    return found.groupBy("start").agg(F.min("title").alias("a"), F.max("title").alias("b")).filter("a <> b").select("start")


def _bits(values: DataFrame):
    """A broadcast set of BITS bits, of which that of each value (one column, bigint) is set: bit v modulo BITS.
    Its parts are made where the values are; the driver gets BITS / 8 bytes, however many values there are."""
    each = 1 << 16

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(v // each):
                one = np.zeros(each, bool)
                one[v[v // each == k] % each] = True
                own[int(k)] = own[int(k)] | np.packbits(one, bitorder="little") if int(k) in own else np.packbits(one, bitorder="little")
        yield pa.RecordBatch.from_pydict({"part": list(own), "bits": [x.tobytes() for x in own.values()]}, pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    v = F.pmod(F.col(values.columns[0]), F.lit(BITS))
    placed = values.select(v.alias("v")).repartition(F.floor(F.col("v") / each))
    whole = np.zeros(BITS // 8, np.uint8)
    for part, bits in placed.mapInArrow(fill, "part bigint, bits binary").collect():
        whole[part * each // 8 : (part + 1) * each // 8] = np.frombuffer(bits, np.uint8)
    return values.sparkSession.sparkContext.broadcast(whole)


def _set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def repeated(clean: DataFrame) -> DataFrame:
    """(page_id, places): word positions of the pages at which a run begins that stands in pages of several titles."""
    # titles are shortened too: seeds choose what is looked at, whole starts decide
    seeds = clean.select(F.explode("seeds").alias("start"), F.expr("cast(title & 4294967295 AS bigint)").alias("title"))
    wanted = _bits(settled(_several(seeds), "run-seeds"))

    def starts(batches):
        hashes, bits = _Hashes(), wanted.value
        for b in pieces(batches, rows=500, size=2 << 20):
            near = [k for k, x in enumerate(b.column(4)) if x.is_valid and len(x) and _set(bits, x.values.to_numpy()).any()]
            ids, hosts, titles, texts = (c.to_pylist() for c in b.take(pa.array(near, pa.int32())).columns[:4])
            low, h, k, at = suffixes(_words(texts), hosts, hashes)
            taken = np.flatnonzero(_set(bits, low))
            yield record(_STARTS, pa.array(h[taken]), pa.array(np.array(titles, np.int64)[k[taken]]), pa.array(np.array(ids, np.int64)[k[taken]]), pa.array(at[taken].astype(np.int32)))

    found = settled(clean.select("page_id", "host", "title", "text", "seeds").mapInArrow(starts, "start bigint, title bigint, page_id bigint, place int"), "run-starts")
    parts = _several(found).select("start", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("part"))
    placed = found.drop("title").withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return placed.join(parts, ["start", "part"], "left_semi").groupBy("page_id").agg(F.collect_set("place").alias("places"))


def without_runs(text: str, places: list[int]) -> tuple[str, int]:
    """``text`` without the words covered by runs of RUN words at ``places``, and how many these are."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    covered = np.zeros(len(words) + 1, np.int64)
    for p in places:
        covered[p : p + RUN] = 1
    out, at, code, k, gone = [], 0, False, 0, 0
    for line in text.splitlines(keepends=True):
        end, own = at + len(line), []
        while k < len(words) and words[k][0] < end:
            own.append(k)
            k += 1
        fence = line.lstrip().startswith("```")
        keep = code or fence or _HEADING.match(line.rstrip("\n")) is not None
        code ^= fence
        if keep or not covered[own].any():
            out.append(line)
        else:
            left = [text[words[i][0] : words[i][1]] for i in own if not covered[i]]
            gone += len(own) - len(left)
            if left:
                out.append(" ".join(left) + ("\n" if line.endswith("\n") else ""))
        at = end
    return "".join(out).strip(), gone


_DONE = pa.schema([("page_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("text", pa.string()), ("boilerplate_words", pa.int32())])


def unmarked(pages: DataFrame) -> DataFrame:
    """(page_id, kinds, text, boilerplate_words): clean text of each page, the kinds of markup its content held, and the words that were removed as repeated."""
    clean = settled(clean_pages(pages), "clean-pages")

    def run(batches):
        for b in pieces(batches):
            ids, own, texts, places = (b.column(i).to_pylist() for i in range(4))
            done = [(t, 0) if not p or not t else without_runs(t, p) for t, p in zip(texts, places)]
            yield record(_DONE, ids, own, [t for t, _ in done], [n for _, n in done])

    places = settled(repeated(clean), "run-places")
    bits = _bits(places.select(F.xxhash64("page_id")))

    def affected(ids: pd.Series) -> pd.Series:
        return pd.Series(_set(bits.value, ids.to_numpy(np.int64)))

    # pages without repeated runs stay where they are
    marked = clean.select("page_id", "kinds", "text", F.pandas_udf(affected, "boolean")(F.xxhash64("page_id")).alias("hit"))
    near, rest = marked.filter("hit").drop("hit"), marked.filter("NOT hit").drop("hit")
    joined = near.join(places, "page_id", "left").select("page_id", "kinds", "text", "places")
    done = "page_id bigint, kinds array<string>, text string, boilerplate_words int"
    return joined.mapInArrow(run, done).unionByName(rest.select("page_id", "kinds", "text", F.lit(0).alias("boilerplate_words")))
