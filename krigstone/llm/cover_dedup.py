"""Removal of long repeated byte strings: suffixes sorted bucket by bucket, with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in any document.  Where
such a string starts is what a sorted suffix array tells: two neighbours have LENGTH bytes in common.
The suffixes of a corpus are too many to be sorted whole, so, as in blockwise construction, a bucket is sorted at
a time, and ties are settled by ranks of a sample that are computed before.  The sample are the
places of each document whose remainder modulo V lies in a difference cover: for any two places
there is a shift below V that takes both into the sample.  So two equal strings of LENGTH bytes hold, at one and the
same shift, two sample suffixes with their first LENGTH - V + 1 bytes in common.

1. Ranks of the sample.  Sample suffixes are dealt to buckets and sorted by these first bytes; those
   without an equal are done with, and so is every suffix that has no others within V.
2. Long ties.  Sample suffixes of one rank are sorted by all that surrounds them, from V - 1 bytes before to LENGTH
   bytes behind.  Where two agree, all suffixes that start within V before them are repeated: most of
   any copy is settled here, without a look at its single suffixes.
3. Short ties.  What is left are the suffixes near the ends of copies.  Where a rank has a member that agrees with
   no other, its suffixes, and those of one member of each kind that agrees, are sorted by their first LENGTH bytes.

Each step asks and answers: blocks of some MB of text send their sorted keys to buckets, each different
key once; a bucket, of bounded size, is sorted in one task; the answer, a bit or a byte a key, goes
back to the block.  A string that a third of all texts share is one key a block.  Texts are written
once, in a bucketed table whose later joins with answers move the answers only.

Strings are sorted and compared by fingerprints, as only equality counts, so a bucket's order isn't that of the
bytes: 32 bits within a bucket in step 1, where a chance match costs work but removes nothing, 64 bits within equal
ranks in step 2, 96 bits in step 3.  Two different strings are taken as equal with the corresponding probabilities.

Defined results: a null or empty text has no bytes; a text shorter than LENGTH loses none; each row counts
as a document, so rows that repeat an id, or have none, repeat each other's strings; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, by_bytes, materialize, partitions, texts

LENGTH = 400
# A difference cover modulo 73, in which each difference but 0 occurs once.
V = 73
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
#: Bytes of text in a block, bytes of it that are fingerprinted at once, and bytes of keys in a bucket.
BLOCK, CHUNK, BUCKET = 8 << 20, 1 << 20, 32 << 20
_rng = np.random.Generator(np.random.PCG64(73))
_TABLES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
ASK = "bucket long, block long, keys binary"
ANSWER = "block long, step int, bucket long, codes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, then those of the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of a base and of its inverse, modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        n = max(n, CHUNK + 1)
        each = (np.full(n, b, np.uint64) for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))
        for x in (both := tuple(each)):
            x[0] = 1
            np.cumprod(x, out=x)
        _powers[which] = both
    return _powers[which]


class Block:
    """Documents one after the other, and what is known of their suffixes so far."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, bits: int):
        self.data, self.length, self.bits = data, length, bits
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.core = length - V + 1
        # sample places: in periods of V from each document's start, as far as a string of the length may hold them;
        # none in a shorter document, which has the first bytes of a place but no such string
        room = np.where(sizes >= length, sizes - self.core + 1, 0)
        period = -(-room // V)
        of = np.repeat(np.arange(len(sizes)), period)
        local = (_runs(np.zeros(len(sizes), np.int64), period) * V)[:, None] + np.array(COVER)
        keep = local < room[of][:, None]
        self.doc = np.repeat(of, len(COVER)).reshape(-1, len(COVER))[keep]
        self.at = self.starts[self.doc] + local[keep]

    def fingerprints(self, lo: np.ndarray, hi: np.ndarray, which: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
        """Of the strings from lo, ascending, to hi, within one document each."""
        out = [np.empty(len(lo), np.uint64) for _ in which]
        first = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + CHUNK, side="right")))
            begin, end = int(self.starts[first]), int(self.ends[last - 1])
            part = slice(*np.searchsorted(lo, [begin, end]).tolist())
            if part.start < part.stop:
                x, y = lo[part] - begin, hi[part] - begin
                for k, w in enumerate(which):
                    up, down = powers(w, end - begin + 1)
                    sums = np.zeros(end - begin + 1, np.uint64)
                    np.cumsum(_TABLES[w][self.data[begin:end]] * up[: end - begin], out=sums[1:])
                    out[k][part] = _mix((sums[y] - sums[x]) * down[x])
            first = last
        return out

    def _by_bucket(self, high: np.ndarray, columns: list[np.ndarray]):
        """(bucket, keys) from columns sorted by the bucket."""
        cuts = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(high)] if len(high) else []
        for x, y in pairwise(cuts):
            yield int(high[x]), b"".join(np.ascontiguousarray(c[x:y]).tobytes() for c in columns)

    # step 1

    def ranks(self):
        """(bucket, keys): the first bytes of the sample, each different one once."""
        (name,) = self.fingerprints(self.at, self.at + self.core, (0,))
        self.name = name >> np.uint64(32 - self.bits)
        self.names, self.times = np.unique(self.name, return_counts=True)
        return self._by_bucket(self.names >> np.uint64(32), [self.names.astype(np.uint32)])

    def take_ranks(self, codes: np.ndarray):
        shared = (codes > 0) | (self.times > 1)
        keep = shared[np.searchsorted(self.names, self.name)] if len(self.names) else np.zeros(0, bool)
        self.at, self.doc, self.name = self.at[keep], self.doc[keep], self.name[keep]

    # step 2

    def surroundings(self):
        """(bucket, keys): rank and surroundings of the sample that is left, each different pair once, and whether it has more than one."""
        lo, hi = np.maximum(self.at - V + 1, self.starts[self.doc]), np.minimum(self.at + self.length, self.ends[self.doc])
        one, two = self.fingerprints(lo, hi)
        shape = ((hi - lo) << 8 | (self.at - lo)).astype(np.uint64)  # how they are cut off by the document's bounds
        around = _mix(one ^ (two << np.uint64(21) | two >> np.uint64(43)) + _mix(shape))
        order = np.lexsort((around, self.name))
        name, around = self.name[order], around[order]
        new = np.append(True, (name[1:] != name[:-1]) | (around[1:] != around[:-1])) if len(order) else np.zeros(0, bool)
        self.pair = np.empty(len(order), np.int64)  # of each place
        self.pair[order] = np.cumsum(new) - 1
        self.chosen = order[new]  # a place of each pair
        many = np.bincount(self.pair, minlength=len(self.chosen)) > 1
        return self._by_bucket(name[new] >> np.uint64(32), [name[new].astype(np.uint32), around[new], many.astype(np.uint8)])

    def take_surroundings(self, codes: np.ndarray):
        settled = (codes & AGREES > 0)[self.pair]
        self.settled = self._starts_before(self.at[settled], self.doc[settled])
        listed = self.chosen[(codes & AGREES == 0) | (codes & LISTS > 0)]
        first, last = self._starts_before(self.at[listed], self.doc[listed])
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, first, 1)
        np.add.at(marks, last, -1)
        self.open = np.flatnonzero(np.cumsum(marks[:-1]) > 0)

    def _starts_before(self, at, doc) -> tuple[np.ndarray, np.ndarray]:
        """From where to where (exclusive) strings of the length start that hold the places within V bytes."""
        return np.maximum(at - V + 1, self.starts[doc]), np.minimum(at, self.ends[doc] - self.length) + 1

    # step 3

    def suffixes(self):
        """(bucket, keys): the first bytes of the suffixes that are left, each different one once."""
        one, two = self.fingerprints(self.open, self.open + self.length)
        two = two.astype(np.uint32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(order) else np.zeros(0, bool)
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.cumsum(new) - 1
        return self._by_bucket(one[new] >> np.uint64(64 - self.bits), [one[new], two[new]])

    def take_suffixes(self, codes: np.ndarray):
        repeated = (codes > 0) | (np.bincount(self.string, minlength=len(codes)) > 1)
        self.repeated = self.open[repeated[self.string]] if len(codes) else self.open[:0]

    def removed(self) -> np.ndarray:
        """A mask of the bytes that go."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        for first, last in (self.settled, (self.repeated, self.repeated + 1)):
            np.add.at(marks, first, 1)
            np.add.at(marks, last + self.length - 1, -1)
        return np.cumsum(marks[:-1]) > 0


#: Bits of an answer in step 2: the surroundings occur more than once; this block lists the suffixes for all that agree.
AGREES, LISTS = 1, 2


def _columns(blobs: list[bytes], *types) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all blobs, one after the other, and how many keys each blob has."""
    width = sum(np.dtype(t).itemsize for t in types)
    counts, out = np.array([len(b) // width for b in blobs]), [[] for _ in types]
    for blob, n in zip(blobs, counts.tolist(), strict=True):
        at = 0
        for column, kind in zip(out, types, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in out], counts


def answer_equal(blobs: list[bytes], *types) -> tuple[np.ndarray, np.ndarray]:
    """1 for each key that another blob has as well."""
    columns, counts = _columns(blobs, *types)
    order = np.lexsort(columns[::-1])
    differ = np.zeros(len(order) - 1, bool)
    for c in columns:
        differ |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(np.append(True, differ))
    sizes = np.diff(np.append(first, len(order)))
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.repeat(sizes > 1, sizes)
    return codes, counts


def answer_surroundings(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    (rank, around, many), counts = _columns(blobs, np.uint32, np.uint64, np.uint8)
    order = np.lexsort((around, rank))
    rank, around, many = rank[order], around[order], many[order]
    new_rank = np.append(True, rank[1:] != rank[:-1])
    first = np.flatnonzero(new_rank | np.append(True, around[1:] != around[:-1]))
    sizes = np.diff(np.append(first, len(order)))
    agrees = (sizes > 1) | (np.maximum.reduceat(many, first) > 0)
    # of each rank, whether a member agrees with no other
    rank_starts = np.flatnonzero(new_rank[first])
    alone = np.repeat(np.logical_or.reduceat(~agrees, rank_starts), np.diff(np.append(rank_starts, len(first))))
    found = np.repeat(agrees * AGREES, sizes).astype(np.uint8)
    found[first] |= np.where(agrees & alone, LISTS, 0).astype(np.uint8)
    codes = np.empty(len(order), np.uint8)
    codes[order] = found
    return codes, counts


_ANSWERS = {1: lambda blobs: answer_equal(blobs, np.uint32), 2: answer_surroundings, 3: lambda blobs: answer_equal(blobs, np.uint64, np.uint32)}


def _blocks(docs: DataFrame, n: int) -> DataFrame:
    """block, doc_ids, sizes and the texts packed, in a table that is bucketed by block."""
    most = BLOCK

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack, number = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        for part in by_bytes(batches, "text", most):
            text = part.column("text")
            bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2] or b"")[int(bounds[0]) : int(bounds[-1])]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([np.diff(bounds)], pa.list_(pa.int64())), "n_bytes": pa.array([len(data)], pa.int64()), "packed": pa.array([pack(data)], pa.binary()),
            })
            number += 1

    packed = texts(docs).mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, n_bytes long, packed binary")
    return bucketed(packed.repartition(n, "block"), n, "block")


def _state(left: pa.Table, right: pa.Table | None, length: int, bits: int, step: int):
    """The block of the one row on the left, after the answers on the right, and what it asks in this step."""
    import zstandard

    sizes = np.asarray(left.column("sizes")[0].values)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("packed")[0].as_py()), np.uint8)
    block = Block(data, sizes, length, bits)
    steps = ((block.ranks, block.take_ranks), (block.surroundings, block.take_surroundings), (block.suffixes, block.take_suffixes))
    answers: dict[int, list] = {1: [], 2: [], 3: []}
    if right is not None:
        for at, bucket, codes in zip(*(right.column(c).to_pylist() for c in ("step", "bucket", "codes")), strict=True):
            answers[at].append((bucket, codes))
    for k, (asks, take) in enumerate(steps, 1):
        asked = asks()
        if k == step:
            return block, asked
        for _ in asked:  # sets what the answers belong to
            pass
        take(np.frombuffer(b"".join(codes for _, codes in sorted(answers[k])), np.uint8))
    return block, None


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """SCHEMA: bytes, bytes and runs of bytes removed, and the bytes that are kept."""
    if length < 2 * V:
        raise ValueError(f"strings of {2 * V} bytes or more")
    n = partitions(docs.sparkSession)
    blocks = _blocks(docs, n)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    keys = total * len(COVER) // V * 13
    bits = max(4 * n - 1, keys // BUCKET).bit_length()
    answers = None
    for step in (1, 2, 3):
        asked = _asked(blocks, answers, length, bits, step)
        found = materialize(asked.groupBy("bucket").applyInArrow(_answering(step), ANSWER))
        answers = found if answers is None else answers.unionByName(found)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block, _ = _state(left, right, length, bits, 4)
        gone = block.removed()
        starts, ends = block.starts, block.ends
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[starts[ends > starts]] = gone[starts[ends > starts]]  # a run doesn't go on from the document before
        runs = np.concatenate([[0], np.cumsum(begins)])
        kept = [block.data[s:e][~gone[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [left.column("doc_ids")[0].values, pa.array(ends - starts), pa.array(total[ends] - total[starts]), pa.array(runs[ends] - runs[starts]), pa.array(kept, pa.binary())]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCHEMA)


def _asked(blocks: DataFrame, answers: DataFrame | None, length: int, bits: int, step: int) -> DataFrame:
    """ASK: what blocks send to buckets in a step."""

    def ask(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        _, asked = _state(left, right, length, bits, step)
        rows = list(asked)
        number = left.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "block": pa.array([number] * len(rows), pa.int64()), "keys": pa.array([k for _, k in rows], pa.binary())})

    if answers is None:
        return blocks.groupBy("block").applyInArrow(lambda table: ask(table), ASK)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASK)


def _answering(step: int):
    """The answers of one bucket to all blocks."""
    answer = _ANSWERS[step]

    def run(table: pa.Table) -> pa.Table:
        codes, counts = answer(table.column("keys").to_pylist())
        ends = np.cumsum(counts)
        parts = [codes[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        k = len(parts)
        return pa.table({"block": table.column("block"), "step": pa.array([step] * k, pa.int32()), "bucket": table.column("bucket"), "codes": pa.array(parts, pa.binary())})

    return run


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
