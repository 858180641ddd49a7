"""Alignment of two tokenizers' tokens over whole texts.

A is a byte-level BPE with a JSON file, B a SentencePiece model.  A encodes a space and the text, B
the text, to which it adds a space of its own, so both cut the same bytes.  A pair of tokens is linked
where their byte ranges overlap, and the two sequences are cut into groups where both have a token's end.

The texts of a step are one run of bytes.  The ends of A's and of B's tokens are counted by their places in
it, once for all documents: where both occur a group ends, where either does a link does, and running sums
of the marks, taken at the documents' bounds, give each document's results.

How many documents hold a pair is known for the whole corpus only.  Tasks gather the different pairs
of about BLOCK bytes of text with the number of their documents; Spark adds these up by pair and joins the
counts back to each block's pairs, so a pair that all texts have is one row a block.  A block's documents
then meet the counts of that block's pairs.  Documents' pairs travel as packed numbers; no text is
shuffled.

Both libraries split texts before they merge, A by its pattern, B at each run of spaces (no piece goes
on behind a space, which is tested for when the model is loaded), so that each different part is encoded by
the library once and remembered.

Defined results: a text that is null or empty, or whose tokens don't spell a space and the text (a U+2581 in
it, for B), has no tokens, zeros and the empty string; each row counts as a document, also where rows
repeat an id or have none; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WIDE, fast_pattern
from .common import by_bytes, materialize

#: Bytes of text that are aligned at once, and of which the pairs are gathered.
STEP = 2 << 20
BLOCK = 8 << 20
#: Different parts that a worker remembers, and characters of them.
MEMO, MEMO_CHARS = 500_000, 32 << 20
#: What stands for a space in pieces of B.
BAR = "▁"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, then those of the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """Bytes and decimal digits of each token, and ids of the parts of texts."""

    def __init__(self, words: list[bytes], split: Callable, encode: Callable):
        self.split, self.encode = split, encode
        self.size = np.array([len(w) for w in words], np.int64)
        self.spelt = np.frombuffer(b"".join(words), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        digits = [str(i).encode() for i in range(len(words))]
        width = max(map(len, digits)) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self._forget()

    def _forget(self):
        self.at: dict[str, int] = {}
        self.chars = 0
        self.ids, self.first, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]):
        found = self.encode(parts)
        sizes = np.array([len(x) for x in found], np.int64)
        self.at.update(zip(parts, range(len(self.at), len(self.at) + len(parts)), strict=True))
        self.chars += sum(map(len, parts))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32)])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.at) > MEMO or self.chars > MEMO_CHARS:
            self._forget()
        split = [self.split(text) for text in texts]
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in self.at))
        if new:
            self._learn(new)
        known = [np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts)) for parts in split]
        at = np.concatenate([*known, np.zeros(0, np.int64)])
        sizes = self.length[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(k) for k in known], dtype=np.int64)])]
        return self.ids[_runs(self.first[at], sizes)], np.diff(bounds)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.spelt[_runs(self.start[ids], self.size[ids])]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: its own where that is
    printable, and letters from 256 on for the others, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str, pattern: str) -> Vocabulary:
    """A: a JSON file of the tokenizers library, whose pattern splits texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters, by_id = byte_letters(), {i: w for w, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    words = [bytes(map(letters.__getitem__, by_id[i])) if set(by_id.get(i, "")) <= set(letters) and i in by_id else b"" for i in range(max(by_id) + 1)]
    near, far = fast_pattern(pattern), regex.compile(pattern).findall
    split = lambda text: near(" " + text) if not WIDE(text) else far(" " + text)
    return Vocabulary(words, split, lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)])


def pieces(path: str) -> Vocabulary:
    """B: a SentencePiece model that puts a space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    words = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(BAR, " ").encode() for i, n in enumerate(names)]
    apart = not any(BAR in n.lstrip(BAR) for n in names) and model.encode("a  b") == [*model.encode("a"), *model.encode(" b")]
    split = re.compile(" +[^ ]*").findall if apart else lambda text: [text]
    space = [model.piece_to_id(BAR)]  # the library gives a lone space no token where it stands for the one that it adds

    def encode(parts):
        found = model.encode([p[1:] for p in parts], num_threads=1)
        return [ids if p != " " else space for p, ids in zip(parts, found, strict=True)]

    return Vocabulary(words, lambda text: split(" " + text), encode)


_loaded: dict[tuple, tuple[Vocabulary, Vocabulary]] = {}


def _load(paths: tuple[str, str, str]) -> tuple[Vocabulary, Vocabulary]:
    """Both vocabularies, once for each worker process."""
    if paths not in _loaded:
        _loaded.clear()
        _loaded[paths] = byte_level(paths[0], paths[1]), pieces(paths[2])
    return _loaded[paths]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of values."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


def _of(values: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The consecutive parts of values that are kept."""
    return values[np.repeat(keep, counts)]


def _listing(a: Vocabulary, b: Vocabulary, a_ids, b_ids, a_group, b_group, n_tokens) -> list[str]:
    """Digests of the documents' groups, as a1,a2|b1;a3|b2,b3; groups are numbered over all documents."""
    place_a = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")
    place_b = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
    last = lambda group: np.append(group[1:] != group[:-1], True)
    width = max(a.digits.shape[1], b.digits.shape[1])
    cells, size = np.zeros((len(a_ids) + len(b_ids), width), np.uint8), np.zeros(len(a_ids) + len(b_ids), np.int64)
    for v, ids, place, group, mark in ((a, a_ids, place_a, a_group, b"|"), (b, b_ids, place_b, b_group, b";")):
        cells[place, : v.digits.shape[1]] = v.digits[ids]
        cells[place, v.n_digits[ids]] = np.where(last(group), mark[0], ord(","))
        size[place] = v.n_digits[ids] + 1
    flat = cells.ravel()
    text = memoryview(flat[flat != 0].tobytes())
    ends = np.cumsum(_sums(size, n_tokens)).tolist()
    return [hashlib.sha256(text[x : e - 1]).hexdigest() for x, e in zip([0, *ends[:-1]], ends, strict=True)]


def aligned(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> dict[str, np.ndarray | list]:
    """Of each text its counts and digest; of all texts that have tokens, one after the other, their
    different pairs (A's id * size of B + B's id), ascending, how often each is linked, and how many they are."""
    out = {c: np.zeros(len(texts), np.int64) for c in (*_COUNTS, "n_pairs")}
    digests = [""] * len(texts)
    rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
    held = [texts[i] for i in rows]
    (a_ids, a_n), (b_ids, b_n) = a.tokens(held), b.tokens(held)
    raw = [b" " + t.encode("utf-8", "replace") for t in held]
    n_bytes = np.array([len(x) for x in raw], np.int64)

    def only(keep):
        nonlocal a_ids, a_n, b_ids, b_n, n_bytes, rows, raw
        a_ids, b_ids = _of(a_ids, a_n, keep), _of(b_ids, b_n, keep)
        a_n, b_n, n_bytes, rows, raw = a_n[keep], b_n[keep], n_bytes[keep], rows[keep], [x for x, k in zip(raw, keep, strict=True) if k]

    only((_sums(a.size[a_ids], a_n) == n_bytes) & (_sums(b.size[b_ids], b_n) == n_bytes))
    data = np.frombuffer(b"".join(raw), np.uint8)
    only(_sums((a.bytes_of(a_ids) != data) | (b.bytes_of(b_ids) != data), n_bytes) == 0)
    total = int(n_bytes.sum())
    empty = {**out, "digests": digests, "keys": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    if not total:
        return empty
    # where tokens end, for all documents at once
    in_a, in_b = (np.bincount(np.cumsum(v.size[ids]) - 1, minlength=total).astype(bool) for v, ids in ((a, a_ids), (b, b_ids)))
    before_a, before_b, groups = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32), np.cumsum(in_a & in_b, dtype=np.int32)
    ends = np.flatnonzero(in_a | in_b)
    which_a, which_b = before_a[ends] - in_a[ends], before_b[ends] - in_b[ends]  # the tokens that each link lies in
    bounds = np.cumsum(n_bytes)
    n_links = np.diff(np.searchsorted(ends, bounds - 1, "right"), prepend=0)
    for name, values in (("n_a", a_n), ("n_b", b_n), ("n_links", n_links), ("n_groups", np.diff(groups[bounds - 1], prepend=0))):
        out[name][rows] = values
    a_ends, b_ends = np.flatnonzero(in_a), np.flatnonzero(in_b)
    closes = (in_a & in_b).astype(np.int32)
    listing = _listing(a, b, a_ids, b_ids, groups[a_ends] - closes[a_ends], groups[b_ends] - closes[b_ends], a_n + b_n)
    for i, digest in zip(rows.tolist(), listing, strict=True):
        digests[i] = digest
    # the different pairs of each document
    shift = int(len(a.size) * len(b.size)).bit_length()
    keys = np.sort(np.repeat(np.arange(len(rows)), n_links) << shift | a_ids[which_a].astype(np.int64) * len(b.size) + b_ids[which_b])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    out["n_pairs"][rows] = np.bincount(keys[first] >> shift, minlength=len(rows))
    return {**out, "digests": digests, "keys": keys[first] & ((1 << shift) - 1), "times": np.diff(np.append(first, len(keys)))}


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T).view(np.int32).ravel().astype(np.int64)


_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())
BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", _LONGS), *((c, _LONGS) for c in (*_COUNTS, "n_pairs")), ("digests", _TEXTS), ("pairs", pa.binary()), ("times", pa.binary()),
    ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("kind", pa.int32()),
])
_DDL = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, digests array<string>, pairs binary, times binary, at int, a int, b int, docs long, kind int"


def _filled(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in BLOCKS], schema=BLOCKS)


def _block(number: int, parts: list[dict], doc_ids: list, b_size: int):
    """A row (kind 0) with the documents of a block, and a row (kind 1) for each different pair of them, numbered."""
    keys, times = (np.concatenate([p[c] for p in parts]) for c in ("keys", "times"))
    every = np.unique(keys)
    at = np.searchsorted(every, keys)
    lists = {c: [np.concatenate([p[c] for p in parts])] for c in (*_COUNTS, "n_pairs")}
    yield _filled(1, block=[number], doc_ids=[doc_ids], **lists, digests=[[d for p in parts for d in p["digests"]]], pairs=[_pack(np.diff(at, prepend=0))], times=[_pack(times)], kind=[0])
    for begin in range(0, len(every), 50_000):
        part = every[begin : begin + 50_000]
        docs = np.bincount(at, minlength=len(every))[begin : begin + 50_000]
        yield _filled(len(part), block=np.full(len(part), number), at=np.arange(begin, begin + len(part)), a=part // b_size, b=part % b_size, docs=docs, kind=np.ones(len(part)))


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """SCHEMA: one row for each document."""
    paths, step, block = (a_path, pattern, b_path), STEP, BLOCK

    def gather(batches):
        from pyspark import TaskContext

        a, b = _load(paths)
        number, parts, doc_ids, held = TaskContext.get().partitionId() << 32, [], [], 0
        for part in by_bytes(batches, "text", step):
            texts = part.column("text").to_pylist()
            parts.append(aligned(texts, a, b))
            doc_ids += part.column("doc_id").to_pylist()
            held += part.column("text").nbytes
            if held >= block:
                yield from _block(number, parts, doc_ids, len(b.size))
                number, parts, doc_ids, held = number + 1, [], [], 0
        if parts:
            yield from _block(number, parts, doc_ids, len(b.size))

    stored = materialize(docs.select("doc_id", "text").mapInArrow(gather, _DDL), by="kind")
    pairs = stored.where("kind = 1").select("block", "at", "a", "b", "docs")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    # one row for each id of A's vocabulary at most
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("top"))
    answers = pairs.join(known, ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "top")
    blocks = stored.where("kind = 0").select("block", "doc_ids", *_COUNTS, "n_pairs", "digests", "pairs", "times")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, top = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at], top[at] = right.column("count").to_numpy(), right.column("top").to_numpy(zero_copy_only=False)
        row = {c: left.column(c)[0] for c in left.column_names}
        held, times = np.cumsum(_unpack(row["pairs"].as_py())), _unpack(row["times"].as_py())
        n_pairs = np.asarray(row["n_pairs"].values)
        columns = [row["doc_ids"].values, *(row[c].values for c in _COUNTS), _sums(times * top[held], n_pairs), _sums(times * count[held], n_pairs), row["digests"].values]
        return pa.table(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, SCHEMA)
