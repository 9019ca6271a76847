"""Problem 6: token ids of every document, with content-defined chunks encoded once.

1. Each text is cut where a rolling hash over the last ``WINDOW`` characters has
   ``CUT_BITS`` zero bits, so equal stretches of different documents give equal chunks.
2. Chunks meet by their hash; a task encodes each different chunk once and hands
   the ids to every place the chunk stands. The exchange may split a hot chunk
   over several tasks (each then encodes it once).
3. Chunks come back to their document in order and are joined. A join is repaired:
   from the start of the left side's last two pre-tokens the text is scanned again until
   the scan meets a boundary of the right chunk's own scan; from there on both agree,
   so the right chunk's remaining ids hold. Text for the repair is decoded from the
   ids, it isn't moved again.

Why that is exact: a pre-token's end depends on at most two characters after it (a
contraction like 're), so all boundaries of a chunk's scan up to the start of its last
two pre-tokens are those of the whole text once its first one is; two scans that meet
at a boundary stay together.

Defined results: null and empty texts give an empty list; a row without id gives
none; rows repeated with the same id and text give one row. No text is changed.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces, record

#: Characters the rolling hash sees; bits that must be zero at a cut (a chunk has 1024 characters on average).
WINDOW, CUT_BITS = 24, 10
#: A chunk without a cut is ended after so many characters.
LONGEST = 8192

_CHUNK = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seq", pa.int32()), ("chunk_hash", pa.int64()), ("chunk", pa.binary())])
CHUNK = "doc_id bigint, text_hash bigint, seq int, chunk_hash bigint, chunk binary"
_CODED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seq", pa.int32()), ("tail", pa.int32()), ("ids", pa.binary())])
CODED = "doc_id bigint, text_hash bigint, seq int, tail int, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
IDS = "doc_id bigint, ids array<int>"


def tokenizer_folder() -> str:
    """Where the public vocabulary files are, if no path is given."""
    for folder in [*sys.path, "/opt"]:
        if (found := __import__("pathlib").Path(folder or ".", "public_tokenizers")).is_dir():
            return str(found)
    return "/opt/tokenizers"


class Encoder:
    """A byte-level BPE with fewer than 65,536 ids, from a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        self.bytes = {v: k for k, v in ranks.items()}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}

    def one(self, token: str) -> bytes:
        """The ids of one pre-token, two bytes each."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 400_000:
                self._known.clear()
            found = np.array(self._bpe.encode_ordinary(token), "<u2").tobytes()
            if len(token) < 64:
                self._known[token] = found
        return found

    def encode(self, text: str) -> tuple[bytes, int]:
        """The ids of ``text``, and how many of them belong to its last two pre-tokens."""
        tokens = self.split(text)
        known = self._known
        try:
            coded = [known[t] for t in tokens]
        except KeyError:
            coded = [self.one(t) for t in tokens]
        return b"".join(coded), sum(map(len, coded[-2:])) // 2

    def decode(self, ids: bytes) -> bytes:
        known = self.bytes
        return b"".join([known[i] for i in np.frombuffer(ids, "<u2").tolist()])


_encoders: dict = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a worker, loaded once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def cuts(codes: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the code points asks for a cut."""
    n = len(codes)
    if n <= WINDOW:
        return np.empty(0, np.int64)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed[1:] += codes[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.cumsum(mixed, dtype=np.uint64)
    rolling = total[WINDOW:] - total[:-WINDOW]
    rolling ^= rolling >> np.uint64(31)
    rolling *= np.uint64(0x94D049BB133111EB)
    return np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WINDOW + 1


def chunks(text: str) -> list[str]:
    """``text`` cut by its content."""
    if len(text) <= WINDOW:
        return [text]
    at = [0, *cuts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist(), len(text)]
    return [text[i : min(i + LONGEST, b)] for a, b in zip(at, at[1:]) for i in range(a, b, LONGEST)]


def _cut(batches):
    for b in pieces(batches):
        rows = [[] for _ in _CHUNK]
        for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ident is None:
                continue
            text = text or ""
            whole = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
            for k, chunk in enumerate(chunks(text)):
                raw = chunk.encode()
                # empty texts have no chunk to meet by
                key = xxhash.xxh3_64_intdigest(raw) - (1 << 63) if raw else ident
                for c, v in zip(rows, (ident, whole, k, key, raw)):
                    c.append(v)
        yield record(_CHUNK, *rows)


def joined(parts, coder: Encoder) -> bytes:
    """The ids of a text from those of its chunks in order, (ids, ids of the last two pre-tokens)."""
    done: list[bytes] = []
    left, tail = parts[0]
    for ids, own_tail in parts[1:]:
        if not left:
            left, tail = ids, own_tail
            continue
        if not ids:
            continue
        at = len(left) - 2 * tail
        open_text = coder.decode(left[at:]).decode()
        reach = 24
        while True:
            whole = 2 * reach >= len(ids)
            head = coder.decode(ids if whole else ids[: 2 * reach])
            head = head.decode() if whole else head.decode("utf-8", "ignore")
            own = coder.split(head)
            scan = coder.split(open_text + head)
            # the last two of a scan that stops inside the chunk may still change
            own, scan = (own, scan) if whole else (own[:-2], scan[:-2])
            ends, place = {}, len(open_text)
            for k, t in enumerate(own):
                place += len(t)
                ends[place] = k + 1
            ends[len(open_text)] = 0
            place = 0
            for k, t in enumerate(scan):
                place += len(t)
                if place in ends and not (whole and ends[place] > len(own) - 2):
                    break
            else:
                k = -1
            if k >= 0:
                skip = sum(len(coder.one(t)) for t in own[: ends[place]])
                done += [left[:at], *map(coder.one, scan[: k + 1])]
                left, tail = ids[skip:], own_tail
                break
            if whole:  # no agreement before the chunk's last two pre-tokens: the chunk is taken up
                coded = [coder.one(t) for t in scan]
                done += [left[:at], *coded[:-2]]
                left = b"".join(coded[-2:])
                tail = len(left) // 2
                break
            reach *= 4
    return b"".join([*done, left])


def _assembled(batches, coder):
    """Documents of sorted rows (doc_id, text_hash, seq, tail, ids)."""
    key, parts = None, []
    ready: list = []

    def flush():
        raw = [np.frombuffer(x, "<u2") for _, x in ready]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int32)
        values = np.concatenate(raw).astype(np.int32) if raw else np.empty(0, np.int32)
        out = record(_IDS, [d for d, _ in ready], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
        ready.clear()
        return out

    size = 0
    for b in batches:
        for ident, whole, seq, tail, ids in zip(*(c.to_pylist() for c in b.columns)):
            if (ident, whole) != key:
                if key is not None:
                    ready.append((key[0], joined(parts, coder)))
                    size += len(ready[-1][1])
                    if size > 4 << 20:
                        yield flush()
                        size = 0
                key, parts = (ident, whole), []
            if seq == len(parts):  # else a row is repeated
                parts.append((ids, tail))
    if key is not None:
        ready.append((key[0], joined(parts, coder)))
    yield flush()


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of each document. path: a file of byte-level BPE ranks; pattern: its pre-token pattern."""
    path = path or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"
    pattern = pattern or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def encoded(batches):
        coder, seen, held = encoder(path, pattern), {}, 0
        for b in pieces(batches):
            rows = [[], []]
            for raw in b.column(4).to_pylist():
                found = seen.get(raw)
                if found is None:
                    if held > 32 << 20:
                        seen, held = {}, 0
                    found = seen[raw] = coder.encode(raw.decode())
                    held += len(raw) + len(found[0]) + 200
                rows[0].append(found[1])
                rows[1].append(found[0])
            yield record(_CODED, b.column(0), b.column(1), b.column(2), *rows)

    def assembled(batches):
        yield from _assembled(pieces(batches, rows=4000), encoder(path, pattern))

    found = documents.select("doc_id", "text").mapInArrow(_cut, CHUNK).hint("rebalance", "chunk_hash").mapInArrow(encoded, CODED)
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "text_hash", "seq").mapInArrow(assembled, IDS)
