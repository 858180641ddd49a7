"""Fill-in-the-middle transformation of whole texts.

A text is cut into units (white space with the word behind it, or white space at the end), two hashes
of the doc_id choose the ends of prefix and middle among them, and two more the form: plain, prefix first
(psm) or suffix first (spm), the parts behind the sentinels <P>, <S> and <M>.

The kernel works on the UTF-8 buffers of an Arrow batch, all rows at once: a lookup of byte classes, a
mask of bytes after which a unit ends, sums of it that start anew with each document, and one
searchsorted for all cuts.  Outputs are gathered from one buffer of sentinels and texts.

Defined results: a null or empty text has no units and stays plain and empty; a null doc_id is hashed as the
empty text; repeated rows give equal results; an empty table gives an empty result; columns other than
doc_id and text are ignored.  Slices of a batch hold STEP bytes of text, or one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts

# The sentinels, and the white space of a unit.
SENTINELS = (b"<P>", b"<S>", b"<M>")
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
FORMS = ("plain", "psm", "spm")
#: Bytes of text that are worked on at once.
STEP = 2 << 20
_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
_STARTS = np.arange(256) & 0xC0 != 0x80  # bytes that begin a code point
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _has_sentinel(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document, whether a sentinel lies within it."""
    if len(data) < 3:
        return np.zeros(len(starts), bool)
    at = np.flatnonzero((data[:-2] == ord("<")) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)) & (data[2:] == ord(">")))
    # the first one from a document's start on, if it ends within the document
    first = np.append(at, len(data))[np.searchsorted(at, starts)]
    return first + 3 <= ends


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each document, and the places in data where its prefix and its middle end.

    data holds the documents from starts to ends, one after the other; draws are h1 and h2 of each.
    """
    blank = _BLANK[data]
    # a unit ends behind a byte of a word that white space or the document's end follows ...
    last = ~blank
    last[:-1] &= blank[1:]
    full = ends > starts
    tails = ends[full] - 1
    last[tails] = True  # ... and with the document
    running = np.cumsum(last)
    before = np.concatenate([[0], running])
    base = before[starts]  # what the sum starts anew from with each document
    n = before[ends] - base
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    # the k-th unit of a document ends where the sum reaches base + k
    at = np.where(units == 0, starts[:, None], np.searchsorted(running, base[:, None] + units) + 1)
    return n, at[:, 0], at[:, 1]


def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, text and h1 to h4 to OUT."""
    text = batch.column("text")
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    h = np.column_stack([batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)])
    n, first, second = cuts(data, starts, ends, h[:, :2]) if len(data) else (np.zeros(len(starts), np.int64), starts, starts)
    plain = (ends == starts) | (h[:, 2] % 100 >= 50) | _has_sentinel(data, starts, ends)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < 80, 2, 1))
    chars = np.concatenate([[0], np.cumsum(_STARTS[data])])
    # six pieces of each row, from a buffer with the sentinels before the texts; a plain row has one
    p, s, m = 0, 3, 6
    source, shift = np.concatenate([np.frombuffer(b"".join(SENTINELS), np.uint8), data]), 9
    zero, three = np.zeros_like(starts), np.full_like(starts, 3)
    prefix, middle, suffix = (starts, first - starts), (first, second - first), (second, ends - second)
    heads = {1: ((p, prefix), (s, suffix), (m, middle)), 2: ((s, suffix), (p, prefix), (m, middle))}
    begin, size = np.zeros((len(starts), 6), np.int64), np.zeros((len(starts), 6), np.int64)
    begin[:, 0], size[:, 0] = starts + shift, np.where(plain, ends - starts, 0)
    for kind, parts in heads.items():
        rows = form == kind
        for i, (sentinel, (at, length)) in enumerate(parts):
            begin[rows, 2 * i], size[rows, 2 * i] = (zero + sentinel)[rows], three[rows]
            begin[rows, 2 * i + 1], size[rows, 2 * i + 1] = (at + shift)[rows], length[rows]
    begin, size = begin.ravel(), size.ravel()
    stop = np.cumsum(size)
    out = source[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    offsets = np.concatenate([[0], stop[5::6]]).astype(np.int32)
    output = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    counts = (pa.array(chars[b] - chars[a], pa.int64(), mask=plain) for a, b in ((starts, first), (first, second)))
    forms = pa.DictionaryArray.from_arrays(pa.array(form, pa.int8()), pa.array(FORMS)).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), forms, *counts, output], schema=OUT)


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the id's seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42) -> DataFrame:
    """SCHEMA: units, form, code points of prefix and middle (null if plain) and the output text."""

    def run(batches):
        for part in by_bytes(batches, "text", STEP):
            yield kernel(part)

    return texts(docs).select("doc_id", "text", *draws(F.col("doc_id"), seed)).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform was made from.

    No sentinel lies in a text that was taken apart, and none arises at a seam, so the first of each
    kind is the one that was put in.
    """
    p, s, m = (x.decode() for x in SENTINELS)
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    part = lambda first, second: (F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1))
    prefix, suffix = part(p, s)
    suffix_first, prefix_behind = part(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_behind, middle, suffix_first))


def digests(docs: DataFrame) -> DataFrame:
    """transform, with digests of the output and of the text restored from it in place of both."""
    found = transform(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same in SQL.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
