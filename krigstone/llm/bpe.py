"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every merge rank has a bucket of linked-list positions.  A bitmap with a summary level marks
the buckets that hold something, so find-first-set on two words gives the lowest rank.
A merge only pushes the two pairs that it creates; entries whose pair has changed since are
recognised by their rank and skipped.  The cost of a pre-token is O(n log n) in its bytes, also
where one pre-token is a whole text.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

#: Entries of a worker's memo of pre-tokens; two generations of this size are kept.
MEMO = 400_000
#: Code points from here on are left to the regex library.
NARROW = 0x250
WIDE = re.compile(f"[{chr(NARROW)}-\U0010ffff]").search
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    The queue is inlined, as most pre-tokens are short: ``top`` has a bit for each block of 256
    ranks, ``blocks`` has a bit for each rank of a block, ``buckets`` has the positions of a rank
    as a heap, so that the leftmost comes first.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    after = list(range(1, n + 2))  # start of the next part
    before = list(range(-1, n))
    pair: list[int | None] = [None] * (n + 1)  # rank of the part at i joined to the next; None: no such rank, or merged away
    top, blocks, buckets = 0, {}, {}
    for i in range(n - 1):
        rank = pair[i] = get(piece[i : i + 2])
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                block = rank >> 8
                top |= 1 << block
                blocks[block] = blocks.get(block, 0) | 1 << (rank & 255)
    while top:
        block = (top & -top).bit_length() - 1
        bits = blocks[block]
        low = bits & -bits
        rank = block << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            blocks[block] = bits = bits ^ low
            if not bits:
                top ^= 1 << block
        if pair[at] != rank:
            continue  # stale
        gone = after[at]
        end = after[at] = after[gone]
        pair[gone] = pair[at] = None
        left = before[at]
        if end < n:
            before[end] = at
            rank = pair[at] = get(piece[at : after[end]])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    block = rank >> 8
                    top |= 1 << block
                    blocks[block] = blocks.get(block, 0) | 1 << (rank & 255)
        if left >= 0:
            rank = pair[left] = get(piece[left:end])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    block = rank >> 8
                    top |= 1 << block
                    blocks[block] = blocks.get(block, 0) | 1 << (rank & 255)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}


def fast_pattern(pattern: str):
    """The matches of pattern in texts below NARROW, found by the standard library's scanner.

    Each property class becomes the list of its members below NARROW, as the regex library
    itself reports them, so that both scanners agree there.
    """
    import regex

    def members(kind: str) -> str:
        found = [c for c in map(chr, range(NARROW)) if regex.match(kind, c)]
        return "".join(map(re.escape, found))

    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + members(r"[\s\p{L}\p{N}]") + "]").replace(r"\S", "[^" + members(r"\s") + "]").replace(kind, "[" + members(kind) + "]")
    return re.compile(pattern).findall


class Codec:
    """Encodes and decodes; remembers pre-tokens, so that frequent ones are merged once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.fast = ranks, regex.compile(pattern).findall, fast_pattern(pattern)
        self.words = {rank: word for word, rank in ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.words}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def ids_of(self, token: str) -> tuple[int, ...]:
        ids = self.recent.get(token) or self.older.get(token) or tuple(merge(token.encode(), self.ranks))
        if len(self.recent) >= MEMO:
            self.older, self.recent = self.recent, {}
        if len(token) < 64:
            self.recent[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        tokens = self.fast(text) if not WIDE(text) else self.find(text)
        found = list(map(self.recent.get, tokens))
        if None in found:
            found = [self.ids_of(token) if ids is None else ids for token, ids in zip(tokens, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        return " ".join(map(self.decimals.__getitem__, ids)).encode()


_codecs: dict[int, Codec] = {}


def _codec(broadcast) -> Codec:
    """One codec for each worker process and vocabulary, so that tasks share what is remembered."""
    key = broadcast.value[2]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*broadcast.value[:2])
    return _codecs[key]


def load(spark, path: str, pattern: str):
    """The vocabulary (a fixed file of about a megabyte), sent once to each executor."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern, f"{path}\n{pattern}"))


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id and the ids of each text, as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in slices(batches):
            ids = [codec.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""

    def run(batches):
        codec = _codec(vocabulary)
        for batch in slices(batches):
            out = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary) -> DataFrame:
    """Encode, decode the ids again, and report digests of both: SCHEMA.

    Both steps run in one pass, so that the ids of a text never leave its task.
    """

    def run(batches):
        codec = _codec(vocabulary)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = codec.encode(text)
                rows.append((doc_id, len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), r, strict=True)) for r in rows], OUT)

    return texts(docs).mapInArrow(run, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
