"""Substring dedup by seed and extend.

Words are runs of anything but white space.  The seeds of a document are its winnowed anchors: of
every 13 consecutive words (a window), the five-word sequence with the least hash, the last one on
ties.  Equal windows choose equal anchors, so documents that share a window meet in the join on
anchors.  There each anchor is extended both ways to every window that chose it, and each such window
is matched with its source: the same window around the same anchor in the document with the smallest
doc_id.  Matches of one document with one source on one diagonal (the distance of their places) are
then joined to maximal repeats, of at least a window (``maximal_repeats``); they are maximal for their source, so
a repeat is cut where a part of it occurs in a document with a still smaller doc_id.  The words of a document
that lie in its repeats with documents of smaller doc_ids are removed.  Windows are judged on the
input, not on what is left.

Anchors and windows are compared by hashes of 48 bits each, so that two different windows are taken as
equal with probability 2**-96 a pair.

Most anchors meet by hash partitioning.  An anchor's equal occurrences within a document are one row
before that.  Hot anchors, whose rows would weigh a quarter of a mean partition, take another way with
the same result: their windows are aggregated before the shuffle, and the result is joined back, which
adaptive execution may split.  Which anchors are hot is judged on a bounded sample of documents; that
decides only which way an anchor takes.

Defined results: a null or empty text has no words; a text of fewer than 13 words loses none; rows
that repeat a doc_id don't remove each other's words, as neither id is smaller, and each loses the
repeats of its own text; rows with a null
doc_id neither lose words nor cost others any; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, texts

WINDOW = 13
GRAM = 5
#: Bytes of a window's hash; it only has to tell windows around one anchor apart.
TAG = 6
#: Documents of the sample that finds hot anchors.
SAMPLE = 4000
_rng = np.random.Generator(np.random.PCG64(20240307))
_MUL = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
SEED = "anchor long, doc_id long, which long, start int, tags binary, more binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _sequences(each: np.ndarray, length: int) -> np.ndarray:
    """Hash of every sequence of so many words."""
    n = len(each) - length + 1
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += each[k : k + n] * _MUL[k]
    return _mix(total)


def windows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of WINDOW words or more: hash of each window, place of its anchor, anchors' hashes."""
    import xxhash

    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = _sequences(each, GRAM)
    span = WINDOW - GRAM + 1
    backwards = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1]
    place = np.arange(len(backwards)) + span - 1 - backwards.argmin(axis=1)
    return _sequences(each, WINDOW), place, grams


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and which."""
    return texts(docs).withColumn("which", F.xxhash64("text"))


def seeds(docs: DataFrame) -> DataFrame:
    """One row for each anchor of each document (which: hash of its text, as ids may repeat): the windows
    that chose it begin at start and the places after it; tags holds TAG bytes of each of their hashes;
    more, if not null, the other starts (int32) where the document has this anchor with equal windows."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("which", pa.int64()), ("start", pa.int32()), ("tags", pa.binary()), ("more", pa.binary())])

    def of_text(text):
        words = words_of(text)
        if len(words) < WINDOW:
            return [], [], [], []
        hashes, place, grams = windows_of(words)
        # places never decrease, so the windows of an anchor are consecutive
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        data = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :TAG]).tobytes()
        ends = (np.append(first[1:], len(place)) * TAG).tolist()
        starts = first.tolist()
        anchors, tags = (grams[place[first]] >> np.uint64(16)).tolist(), [data[x * TAG : e] for x, e in zip(starts, ends, strict=True)]
        if len(set(anchors)) == len(anchors):
            return anchors, starts, tags, [None] * len(anchors)
        met: dict[tuple, list[int]] = {}
        for anchor, start, tag in zip(anchors, starts, tags, strict=True):
            met.setdefault((anchor, tag), []).append(start)
        return [k[0] for k in met], [v[0] for v in met.values()], [k[1] for k in met], [np.array(v[1:], np.int32).tobytes() if len(v) > 1 else None for v in met.values()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [of_text(t) for t in part.column(1).to_pylist()]
                counts = np.array([len(f[0]) for f in found])
                ids, which = (np.repeat(part.column(i).to_numpy(), counts) for i in (0, 2))
                anchors, starts, tags, more = ([x for f in found for x in f[i]] for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(ids), pa.array(which), pa.array(starts, pa.int32()), pa.array(tags, pa.binary()), pa.array(more, pa.binary())], schema=schema)

    return _texts(docs).where("doc_id is not null").mapInArrow(run, SEED)


def hot_anchors(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Anchors with more rows in a bounded sample than a quarter of a partition has on average.  Their
    rows add up to those of the sample at most, so there are at most four for each partition."""
    # ids only are sorted; their texts are read where they are
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = materialize(seeds(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")).select("anchor"))
    mean = found.count() / partitions(docs.sparkSession)
    return found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= max(4, mean / 4)).select("anchor")


def _windows(rows: DataFrame) -> DataFrame:
    """One row for each window, with the place that it has in its document."""
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.octet_length("tags") / TAG).cast("int") - 1)))
    tag = F.substring("tags", F.col("k") * TAG + 1, F.lit(TAG))
    return each.select("anchor", "doc_id", "which", "start", "more", "k", (F.col("start") + F.col("k")).alias("place"), tag.alias("tag"))


def _matches(windows: DataFrame) -> DataFrame:
    """doc_id, which, start, more, source, shift (places in the source less places here) and a bit for each
    window that is matched so.  An anchor has fewer than 16 windows."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("k"))
    met = windows.where(F.col("first.doc_id") < F.col("doc_id")).withColumn("shift", F.col("first.place") - F.col("place"))
    return met.groupBy("anchor", "doc_id", "which", "start", "more", F.col("first.doc_id").alias("source"), "shift").agg(F.bit_or(bit).alias("bits"))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, which and marks: array of (start, more, bits, source, shift) of its matched windows."""
    hot = materialize(hot_anchors(docs))
    found = seeds(docs)
    least = F.min(F.struct("doc_id", "place"))
    by_anchor, by_window = Window.partitionBy("anchor"), Window.partitionBy("anchor", "tag")
    # cold anchors: one exchange by anchor; everything after it stays within a partition
    cold = (
        found.join(F.broadcast(hot), "anchor", "left_anti")
        .withColumn("first_doc", F.min("doc_id").over(by_anchor)).withColumn("last_doc", F.max("doc_id").over(by_anchor))
        .where("first_doc < last_doc").drop("first_doc", "last_doc")
    )
    marks = _matches(_windows(cold).withColumn("first", least.over(by_window)))
    if hot.limit(1).count():
        # hot anchors: aggregated before the shuffle, then joined back
        warm = materialize(_windows(found.join(F.broadcast(hot), "anchor", "left_semi")))
        firsts = warm.groupBy("anchor", "tag").agg(least.alias("first"), F.max("doc_id").alias("last_doc")).where("first.doc_id < last_doc").drop("last_doc")
        marks = marks.unionByName(_matches(warm.join(materialize(firsts), ["anchor", "tag"])))
    return marks.groupBy("doc_id", "which").agg(F.collect_list(F.struct("start", "more", "bits", "source", "shift")).alias("marks"))


def _extended(marks) -> list[tuple[int, int, int, int]]:
    """(start, words, source, start in the source) of the maximal repeats that a document's matches add up to."""
    lines: dict[tuple[int, int], list[int]] = {}
    for mark in marks or ():
        starts = [mark["start"], *np.frombuffer(mark["more"] or b"", np.int32).tolist()]
        for at in starts:
            # a repeat within the document has its own diagonal to the one place in the source
            line = lines.setdefault((mark["source"], mark["shift"] + mark["start"] - at), [])
            line.extend(at + k for k in range(mark["bits"].bit_length()) if mark["bits"] >> k & 1)
    out = []
    for (source, shift), places in lines.items():
        begin = last = None
        for at in sorted(set(places)):
            if last is not None and at > last + 1:
                out.append((begin, last + WINDOW - begin, source, begin + shift))
                begin = at
            begin, last = (at if begin is None else begin), at
        out.append((begin, last + WINDOW - begin, source, begin + shift))
    return sorted(out)


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, which, start, n_words, source_doc, source_start: runs of words that documents repeat from
    the smallest doc_id that holds them."""
    schema = pa.schema([("doc_id", pa.int64()), ("which", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = [(i, w, *r) for i, w, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in _extended(marks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], schema=schema)

    return matches(docs).mapInArrow(run, "doc_id long, which long, start long, n_words long, source_doc long, source_start long")


def _kept(words: list[bytes], marks) -> np.ndarray:
    keep = np.ones(len(words), bool)
    for start, n, _, _ in _extended(marks):
        keep[start : start + n] = False
    return keep


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, which and the text compressed, as all texts go through a shuffle."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = [pack(t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "which", "packed"])

    return _texts(docs).mapInArrow(run, "doc_id long, which long, packed binary")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, gone, kept = [], [], []
            for packed, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpack(packed).split()
                keep = _kept(words, marks)
                n.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(words if not gone[-1] else [words[i] for i in np.flatnonzero(keep)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    joined = _packed(docs).join(matches(docs), ["doc_id", "which"], "left").select("doc_id", "packed", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
