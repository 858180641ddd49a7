"""Media columns: content-defined chunking, a deduplicated chunk store, and verified restoring.

A payload is stored losslessly as an 8-bit mono WAV.  A rolling gear hash over the last 64 bytes
cuts the file where its top bits are zero, between LEAST and MOST bytes after the last cut.  A file
is then an ordered list of chunk digests (``manifests``).

Storing: digests alone are joined to find each chunk's owner, the least of the files that hold it.
Compressed files then cross one shuffle to meet the list of what they own, and each writes the chunks
that it owns, and no others, as one pack in the shared folder (``store``).  So equal chunks are stored
once, and chunk bytes are shuffled once.

Restoring (``restore``): a file that owns all of its chunks is read back from its pack alone.  The
others are dealt into blocks of bounded size by a hash of their key.  A block asks for each of its
different chunks once, however many of its files hold it, so a chunk that most files share is sent
once to each block and never gathers the files in one place.  Every restored file is compared with
the digest in its manifest.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal values
in every column but doc_id; repeated rows give repeated results (files are keyed by the digest of
their content, so rows sharing a doc_id don't mix); a null doc_id is carried; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, partitions, texts

UNIT = 64
LEAST, MOST = 1 << 10, 1 << 15
CUT_BITS = 12
RATE = 8000
#: Bytes of files that one block restores, besides its longest file.
BLOCK_BYTES = 32 << 20
HEADER = 44
_GEAR = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> np.ndarray:
    riff, _, wave, _, _, form, channels, _, _, _, bits, mark, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, form, channels, bits, mark) != (b"RIFF", b"WAVE", 1, 1, 8, b"data"):
        raise ValueError("not an 8-bit mono WAV")
    return np.frombuffer(media, np.uint8, size, HEADER)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks.  The hash of the last 64 bytes is built by doubling, for all places at once."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 64:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint64(span) if len(h) > span else 0
        h = h + shifted
        span *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:20]


def feature(samples: np.ndarray) -> str:
    """Eight energies of equal parts of the signal, its mean, and its zero-crossing rate."""
    x = samples.astype(np.float64) - 128
    parts = np.array_split(x, 8)
    crossings = int((np.diff(np.signbit(x)) != 0).sum())
    return ",".join(f"{np.sqrt((p * p).mean()) if len(p) else 0:.3f}" for p in parts) + f";{x.mean():.3f};{crossings / len(x):.4f}"


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, digest of the media, digests of its chunks in order and their sizes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("chunks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            n, media, lists, sizes = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = to_wav(payload_of(text))
                parts = chunks_of(data)
                n.append(len(text.encode("utf-8", "replace")))
                media.append(digest(data))
                lists.append([digest(c) for c in parts])
                sizes.append([len(c) for c in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(lists, schema.field(3).type), pa.array(sizes, schema.field(4).type)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, chunks array<binary>, sizes array<int>")


def _files(docs: DataFrame) -> DataFrame:
    """media and packed: every different file, compressed.  A task sends what repeats in a batch once."""
    schema = pa.schema([("media", pa.binary()), ("packed", pa.binary())])

    def run(batches):
        for batch in batches:
            own: dict[bytes, bytes] = {}
            for text in dict.fromkeys(batch.column(0).to_pylist()):
                data = to_wav(payload_of(text))
                own[digest(data)] = bz2.compress(data)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], schema=schema)

    found = texts(docs).select("text").mapInArrow(run, "media binary, packed binary")
    return found.groupBy("media").agg(F.first("packed").alias("packed"))


def _owners(listed: DataFrame) -> DataFrame:
    """media, chunks, sizes and own, of every different file: the places of the chunks that it owns (each at its
    first place in the file), and whether other files have them."""
    contents = listed.groupBy("media").agg(F.first(F.struct("chunks", "sizes")).alias("c")).select("media", "c.*")
    each = contents.select("media", F.posexplode("chunks").alias("at", "digest"))
    # partial aggregation before the shuffle: a chunk in most files is a row a task
    owner = each.groupBy("digest").agg(F.min(F.struct("media", "at")).alias("first"), F.max("media").alias("last"))
    held = owner.select(F.col("first.media").alias("media"), F.struct(F.col("first.at").alias("at"), (F.col("last") != F.col("first.media")).alias("shared")).alias("own"))
    held = held.groupBy("media").agg(F.collect_list("own").alias("own"))  # at most the chunks of a file
    return contents.join(held, "media", "left")


def _flags(chunks: list[bytes], own: list[dict] | None) -> tuple[list[bool], list[bool], bool]:
    """For each place whether the file's pack holds the chunk, and whether the chunk will be asked for elsewhere; and
    whether the file owns all of its chunks."""
    shared = {x["at"]: x["shared"] for x in own or ()}
    whole = len(shared) == len(set(chunks))
    keeps = [i in shared for i in range(len(chunks))]
    return keeps, [k and (not whole or shared[i]) for i, k in enumerate(keeps)], whole


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, packs), both in the shared folder.

    packs: media, chunks, sizes, keeps, sends and whole (see ``_flags``), and pack: the kept chunks one
    after the other, compressed; null where a file keeps none.
    """
    listed = materialize(manifests(docs))
    plan = _owners(listed)
    schema = pa.schema([("media", pa.binary()), ("chunks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("keeps", pa.list_(pa.bool_())), ("sends", pa.list_(pa.bool_())), ("whole", pa.bool_()), ("pack", pa.binary())])

    def run(batches):
        for batch in batches:
            packs, flags = [], []
            for chunks, sizes, own, packed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                flags.append(_flags(chunks, own))
                keeps = flags[-1][0]
                if not any(keeps):
                    packs.append(None)
                elif all(keeps):
                    packs.append(packed)
                else:
                    data, ends = bz2.decompress(packed), np.cumsum(sizes).tolist()
                    packs.append(bz2.compress(b"".join(data[e - n : e] for e, n, k in zip(ends, sizes, keeps, strict=True) if k)))
            found = [pa.array([f[k] for f in flags], schema.field(3 + k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found, pa.array(packs, pa.binary())], schema=schema)

    fields = "media binary, chunks array<binary>, sizes array<int>, keeps array<boolean>, sends array<boolean>, whole boolean, pack binary"
    joined = plan.join(_files(docs), "media").select("media", "chunks", "sizes", "own", "packed")
    return listed, materialize(joined.mapInArrow(run, fields))


def _kept_chunks(chunks, sizes, keeps, pack) -> dict[bytes, bytes]:
    """digest to bytes of what a pack holds."""
    data, at, out = bz2.decompress(pack) if pack else b"", 0, {}
    for key, n, keep in zip(chunks, sizes, keeps, strict=True):
        if keep:
            out[key] = data[at : at + n]
            at += n
    return out


def _joined(key: bytes, parts, have: dict[bytes, bytes]) -> bytes:
    media = b"".join(have[p] for p in parts)
    if digest(media) != key:
        raise ValueError("restored bytes differ from the manifest's digest")
    return media


def _sent_chunks(packs: DataFrame) -> DataFrame:
    """digest and compressed bytes of the chunks that others ask for."""

    def run(batches):
        for batch in batches:
            keys, data = [], []
            for chunks, sizes, keeps, sends, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = _kept_chunks(chunks, sizes, keeps, pack)
                for key, send in zip(chunks, sends, strict=True):
                    if send:
                        keys.append(key)
                        data.append(bz2.compress(have[key]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return packs.where(F.exists("sends", lambda s: s)).select("chunks", "sizes", "keeps", "sends", "pack").mapInArrow(run, "digest binary, data binary")


def restore(listed: DataFrame, packs: DataFrame, per_media=None, fields: str = "restored binary") -> DataFrame:
    """listed (manifests) with the restored media, or with what per_media makes of its bytes.

    Files of the same content are restored once.
    """
    spark = listed.sparkSession
    make = per_media or (lambda media: (media,))
    names = ["media", *(f.split()[0] for f in fields.split(", "))]
    kinds = spark.createDataFrame([], f"media binary, {fields}").schema
    types = to_arrow_schema(kinds)

    def table(rows):
        return pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=types)

    def alone(batches):
        for batch in batches:
            rows = []
            for key, chunks, sizes, keeps, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((key, *make(_joined(key, chunks, _kept_chunks(chunks, sizes, keeps, pack)))))
            yield from table(rows).to_batches()

    whole = packs.where("whole").select("media", "chunks", "sizes", "keeps", "pack").mapInArrow(alone, kinds)
    lacking = packs.where("not whole")
    total = lacking.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    blocks = max(4 * partitions(spark), -(-total // BLOCK_BYTES))
    lacking = lacking.select("media", "chunks", F.pmod(F.xxhash64("media"), F.lit(blocks)).alias("block"))
    wanted = lacking.select("block", F.explode("chunks").alias("digest")).distinct()
    sent = wanted.join(_sent_chunks(packs), "digest").select(F.col("block").alias("to_block"), "digest", "data")

    def run(files: pa.Table, chunks: pa.Table) -> pa.Table:
        have = {k: bz2.decompress(v) for k, v in zip(chunks.column("digest").to_pylist(), chunks.column("data").to_pylist(), strict=True)}
        rows = zip(files.column("media").to_pylist(), files.column("chunks").to_pylist(), strict=True)
        return table((key, *make(_joined(key, parts, have))) for key, parts in rows)

    others = lacking.groupBy("block").cogroup(sent.groupBy("to_block")).applyInArrow(run, kinds)
    return listed.drop("chunks", "sizes").join(whole.unionByName(others), "media").drop("media")


def describe(media: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    samples = samples_of(media)
    payload = samples.tobytes()
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
        len(media), hashlib.sha256(media).hexdigest(), feature(samples),
    )


DESCRIBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as media in chunks, restore it from the chunk store, and describe it."""
    return restore(*store(docs), describe, DESCRIBED)
