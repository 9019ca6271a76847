"""Problem 1: records that differ only in layout.

A record's key is what is left of title and content once composition, letter
case, white space, punctuation, other signs and field order are taken away. The
key never leaves its task: a 128-bit hash of it does, with an independent 64-bit
hash and the key's length as a collision check.

Defined results: a null title, or a content without letter or digit, is never a
copy; a title without letters that isn't null equals another such title. Rows
repeated with one id count once. Records that aren't one JSON object, or whose
fields aren't strings, count as without title and content. ``counted`` also gives
the pages that are never copies, with one copy each; of the records, those that are
one JSON object are pages. Other columns, also
ones named like the fields, are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record

KEYS = "page_id bigint, hash binary, guard bigint, length bigint"
_KEYS = pa.schema([("page_id", pa.int64()), ("hash", pa.binary()), ("guard", pa.int64()), ("length", pa.int64())])

#: Parts that a set of copies is joined in, so that one set may hold any share of the rows.
SALTS = 16

_kept: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point, whether it is a letter or a digit."""
    global _kept
    if _kept is None:
        _kept = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _kept


def folded(text: str) -> bytes:
    """The letters and digits of ``text`` in order, composed and without letter case."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    codes = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_letters()[codes]].tobytes()


def _emit(rows, lone=False):
    ids, hashes, guards, lengths = [], [], [], []
    for page, title, content in rows:
        if page is None:
            continue
        body = folded(content) if isinstance(title, str) and isinstance(content, str) else b""
        if not body:
            if lone:  # a key of its own; those of other pages have a length
                ids.append(page)
                hashes.append(page.to_bytes(8, "little", signed=True))
                guards.append(0)
                lengths.append(0)
            continue
        head = folded(title)
        key = len(head).to_bytes(8, "little") + head + body
        ids.append(page)
        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
        guards.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
        lengths.append(len(key))
    return record(_KEYS, ids, hashes, guards, lengths)


def _of_pages(batches, lone=False):
    for b in pieces(batches):
        yield _emit(zip(*(b.column(i).to_pylist() for i in range(3))), lone)


def _opened(text):
    """Whether ``text`` is one JSON object, its title and its content."""
    try:
        found = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return False, None, None
    return (True, found.get("title"), found.get("content")) if isinstance(found, dict) else (False, None, None)


def _of_records(batches, lone=False):
    for b in pieces(batches):
        opened = ((i, *_opened(r)) for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield _emit(((i, t, c) for i, valid, t, c in opened if valid), lone)


def page_keys(pages: DataFrame, records: DataFrame | None = None, lone: bool = False) -> DataFrame:
    """(page_id, hash, guard, length) of each page, and of each record that is valid JSON.
    lone: also of those that are never copies, each with a key of its own (of length 0)."""
    keys = pages.select("page_id", "title", "content").mapInArrow(partial(_of_pages, lone=lone), KEYS)
    if records is not None:
        keys = keys.unionByName(records.select("page_id", "record").mapInArrow(partial(_of_records, lone=lone), KEYS))
    return keys


def copy_sets(keys: DataFrame) -> DataFrame:
    """One row for each distinct page: its key, smallest id and number of copies.

    Partial counts are combined before the shuffle, so a set that holds a third
    of all rows moves as one row for each task. The guard and the length are part
    of the key: two texts that share the 128-bit hash stay apart.
    """
    return keys.groupBy("hash", "guard", "length").agg(
        F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("*").alias("copies")
    )


def collisions(keys: DataFrame) -> DataFrame:
    """Hashes under which more than one key was seen, told apart by guard and length."""
    return keys.groupBy("hash", "guard", "length").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.count("*").alias("keys"), F.sum("n").alias("rows")
    ).filter("keys > 1")


def copies(keys: DataFrame) -> DataFrame:
    """(first_id, copy_id) of each member of a set of copies but the first.

    Only sets of two and more are joined back, in ``SALTS`` parts each.
    """
    sets = (
        copy_sets(keys).filter("last_id > first_id").select("hash", "guard", "length", "first_id", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("part"))
    )
    members = keys.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return (
        members.join(sets, ["hash", "guard", "length", "part"]).filter("page_id > first_id").select("first_id", F.col("page_id").alias("copy_id")).distinct()
    )


def collapsed(pages: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One record for each set of copies, (page_id, copies), with pages that have none."""
    return copy_sets(page_keys(pages, records)).select(F.col("first_id").alias("page_id"), "copies")


def counted(keys: DataFrame) -> DataFrame:
    """(page_id, copies): one record for each page, from ``page_keys`` with ``lone``."""
    return copy_sets(keys).select(F.col("first_id").alias("page_id"), F.when(F.col("length") == 0, F.lit(1).cast("bigint")).otherwise(F.col("copies")).alias("copies"))
