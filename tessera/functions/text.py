"""Text expressions (Column to Column). Null stays null in all of them unless stated."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as v

#: White space as Python's str.split takes it.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often a function inside f comes back to it (the arguments of
    higher-order functions are computed again for every element)."""
    return F.element_at(F.transform(F.array(c), f), 1)


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def squeezed(c: Column) -> Column:
    """Words with one blank between them."""
    return F.array_join(words(c), " ")


def plain_article(c: Column) -> Column:
    """A fetched article: no parentheses, line breaks, double quotes or runs of blanks."""
    return squeezed(F.translate(F.regexp_replace(c, r"\(.*?\)", ""), '\n"', " "))


def plain_wiki(c: Column, sections: list[str] = v.SECTIONS) -> Column:
    """A wiki page cut at the first unwanted section that starts a line, without references,
    templates, files, categories, bold and italic marks and link targets; headings as lines of their own."""
    cut = rf"(?smiu)^\s*==\s*({'|'.join(sections)})\s*==.*"
    for pattern, by in (
        (cut, ""),
        (r"(?siu)<ref.*?>.*?</ref>", ""),
        (r"(?s)\{\{.*?\}\}", ""),
        (r"(?iu)\[\[Файл:.*?\]\]", ""),
        (r"(?iu)\[\[Категория:.*?\]\]", ""),
        ("'''(.*?)'''", "$1"),
        ("''(.*?)''", "$1"),
        (r"==+\s*(.*?)\s*==+", "\n\n$1\n"),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        ("\n{3,}", "\n\n"),
        ("[ \t]+", " "),
    ):
        c = F.regexp_replace(c, pattern, by)
    return stripped(c)


def cut_at_markers(c: Column, markers: list[str] = v.MARKERS) -> Column:
    """Cut before the earliest marker (and stripped if cut)."""
    places = F.array(*[F.locate(m, c) for m in markers])
    first = F.array_min(F.filter(places, lambda x: x > 0))
    return F.when(first.isNotNull(), stripped(F.substring(c, F.lit(1), first - 1))).otherwise(c)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def composed(c: Column) -> Column:
    """In canonical composition (a vectorized Python function; only needed where marks occur)."""
    return _nfc(c)


def question_key(c: Column, compose: bool = True) -> Column:
    """What equal questions share: composed, lower case, one blank between words, then no signs."""
    c = composed(c) if compose else c
    return F.regexp_replace(squeezed(F.lower(c)), r"[^\p{L}\p{M}\p{N}_\s\p{Z}]", "")


def mended(c: Column) -> Column:
    """Latin letters of words that hold both scripts as the Cyrillic ones they look like."""
    for wrong, right in v.CORRECTIONS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    parts = F.regexp_extract_all(c, F.lit(rf"{SPACE}+|[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+"), F.lit(0))
    both = lambda w: w.rlike("[a-zA-Z]") & w.rlike("[а-яА-ЯёЁ]")
    return F.array_join(F.transform(parts, lambda w: F.when(both(w), F.translate(w, v.LATIN, v.CYRILLIC)).otherwise(w)), "")


def option_text(c: Column) -> Column:
    """An option without its leading letter."""
    return stripped(F.regexp_replace(stripped(c), r"^[А-ГA-D][).]\s*", ""))


def unfenced(c: Column, language: str = "turtle") -> Column:
    """The fenced blocks of a model's reply joined, or the reply itself, stripped."""
    own = F.regexp_extract_all(c, F.lit(rf"(?s)```{language}\s*(.*?)(?:```|\z)"), F.lit(1))
    bare = F.regexp_extract_all(c, F.lit(r"(?s)```\w*\s*(.*?)(?:```|\z)"), F.lit(1))
    return stripped(F.when(F.size(own) > 0, F.array_join(own, "\n")).when(F.size(bare) > 0, F.array_join(bare, "\n")).otherwise(c))


def without_country(c: Column) -> Column:
    """The query in lower case without the country, if something is left of it."""
    low = F.lower(c)
    rest = stripped(F.replace(F.replace(low, F.lit("в българия"), F.lit("")), F.lit("българия"), F.lit("")))
    n = F.size(words(rest))
    return F.when(F.contains(low, F.lit("българия")) & ((n > 1) | ((n == 1) & (F.length(rest) > 3))), rest).otherwise(c)


def year_of(url: Column) -> Column:
    """The year in a url, from 2008 on, or ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(url, "(200[89]|201[0-9]|202[0-9])", 1), F.lit("")), F.lit("unknown"))


def answer_letter(c: Column) -> Column:
    """The first letter A to D that stands alone, Cyrillic ones as Latin; null where there is none."""
    found = F.regexp_extract(c, r"(?<![\p{L}\p{N}_])([ABCDАВСД])(?![\p{L}\p{N}_])", 1)
    return F.nullif(F.translate(found, "АВСД", "ABCD"), F.lit(""))


def stem(w: Column) -> Column:
    """The first max(4, length - 3) characters."""
    return F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 3))


def keywords(query: Column) -> Column:
    """Distinct words of a query in lower case with more than two characters that are no stop words."""
    return F.array_distinct(F.filter(words(F.lower(query)), lambda w: (F.length(w) > 2) & ~w.isin(v.STOP_WORDS)))


def holds_any(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs in the text."""
    found = F.lit(False)
    for x in parts:
        found = found | F.contains(c, F.lit(x))
    return found


def keyword_hits(c: Column, parts: list[str]) -> Column:
    """How many of the parts occur in the text."""
    return sum((F.contains(c, F.lit(x)).cast("int") for x in parts), F.lit(0))
