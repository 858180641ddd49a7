"""Quality classifier from compressed sizes.

One zstandard dictionary is built from good and one from bad labelled texts.  Every whole text
is compressed with each.  The difference of the two sizes, normalised by the length of the text, is
the only input of the score; a logistic calibration maps it to (0, 1).

The fit uses a bounded sample of labelled rows that have a text, whatever its length: of each class the first
in the order of a digest of their doc_id, at most ``per_class`` rows and, of these, as many as hold ``most_bytes`` bytes
together.  Texts are whole wherever they are used.  The driver receives at most 2 * most_bytes bytes of them.
The calibration is fitted to differences of texts that were not in the dictionaries: each half of the
sample is compressed with dictionaries of the other half.

Defined results: a null or empty text has the difference 0 and the score of that; if a class has fewer
than MIN_TEXTS sampled texts, every score is the share of good labels (0.5 without labels); repeated
rows get equal scores and count once in the sample; labels with a null quality or doc_id are ignored;
an empty table gives an empty result; only doc_id and text of docs are read, and ``keep_good`` returns
all columns whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts

PER_CLASS = 3000
MOST_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MIN_TEXTS = 16
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _compressors(dictionaries):
    import zstandard

    out = []
    for data in dictionaries:
        words = zstandard.ZstdCompressionDict(data)
        words.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))
    return out


def _difference(compressors, data: bytes) -> float:
    """How many bytes the dictionary of good texts saves over the other, for each byte of the text."""
    good, bad = (len(c.compress(data)) for c in compressors)
    return (bad - good) / (len(data) + 16)


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slope of the greatest penalised likelihood, by Newton steps on a scaled input."""
    scale = float(x.std()) or 1.0
    x = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.array([1.0, scale])


def _dictionary(rows: list[bytes]) -> bytes:
    import zstandard

    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, rows)) // 8))
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the texts themselves are the dictionary
        return b"".join(rows)[-size:]


def fit(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS, most_bytes=MOST_BYTES) -> dict:
    """A model of bounded size from rows outside the held-out fold."""
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .withColumn("turn", F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")).cast("binary")))
    )
    count = {q: int(n) for q, n in marked.groupBy("quality").count().collect()}
    share = (count.get(1, 0) / sum(count.values())) if count else 0.5
    held = texts(docs).where("text <> ''")
    # ids, digests and sizes of all rows with a label; of their texts, only the sample's go further
    rows = held.select("doc_id", F.xxhash64("text").alias("which"), F.octet_length("text").alias("n_bytes")).join(marked, "doc_id").distinct()
    rows, keys = materialize(rows), []
    for q in (0, 1):
        first = rows.where(F.col("quality") == q).orderBy("turn", "doc_id", "which").limit(per_class).collect()
        total = 0
        for i, r in enumerate(first):
            total += r["n_bytes"]
            if total > most_bytes:
                break
            keys.append((r["doc_id"], r["which"], q, i))
    if min(sum(k[2] == q for k in keys) for q in (0, 1)) < MIN_TEXTS:
        return {"share": share}
    wanted = docs.sparkSession.createDataFrame(keys, "doc_id long, which long, quality int, turn int")
    found = held.withColumn("which", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "which"]).dropDuplicates(["doc_id", "which", "quality"])
    sample = sorted((r["quality"], r["turn"], r["text"].encode("utf-8", "replace")) for r in found.select("quality", "turn", "text").collect())
    rows = {q: [t for x, _, t in sample if x == q] for q in (0, 1)}
    x, y = [], []
    for k in (0, 1):  # the halves alternate in the order of the sample
        compressors = _compressors([_dictionary(rows[q][1 - k :: 2]) for q in (1, 0)])
        for q in (0, 1):
            x += [_difference(compressors, t) for t in rows[q][k::2]]
            y += [float(q)] * len(rows[q][k::2])
    weight = _calibrate(np.array(x), np.array(y))
    # the sample is nearer to balance than the table: shift the intercept to the table's odds
    have, true = np.clip(np.mean(y), 1e-6, 1 - 1e-6), np.clip(share, 1e-6, 1 - 1e-6)
    weight[0] += np.log(true / (1 - true)) - np.log(have / (1 - have))
    return {"share": share, "dictionaries": [_dictionary(rows[q]) for q in (1, 0)], "weights": weight.tolist()}


def _score(x: list[float], weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + weights[1] * np.array(x, float), -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""
    if "weights" not in model:
        return docs.select("doc_id", F.lit(model["share"]).cast("double").alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a calibration
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        compressors = _compressors(sent.value["dictionaries"])
        for batch in slices(batches):
            found = _score([_difference(compressors, t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()], sent.value["weights"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns, in one pass over docs."""
    model = fit(docs, labels, **options)
    if "weights" not in model:
        return docs if model["share"] >= threshold else docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        compressors = _compressors(sent.value["dictionaries"])
        for batch in slices(batches):
            found = _score([_difference(compressors, (t or "").encode("utf-8", "replace")) for t in batch.column(place).to_pylist()], sent.value["weights"])
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
