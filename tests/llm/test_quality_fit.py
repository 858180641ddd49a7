"""The quality model and every score against a plain version, and the bounds of the sample."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard

from krigstone.llm import compression_quality as cq


def table(spark, n=240, seed=2):
    rng = random.Random(seed)
    good, bad = ("the river ran by the old house and nobody came", "BUY now cheap!!! click http win $$$ free")
    rows = []
    for i in range(n):
        words = (good if i % 3 else bad).split()
        rows.append((i, " ".join(rng.choice(words) + rng.choice(("", "", str(rng.randrange(99)))) for _ in range(rng.choice((5, 40, 200))))))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(n)] + [(500, 1), (501, 0), (None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    return rows, docs, labels


def plain(rows, docs, count):
    """Dictionaries, sizes, the calibration by a search instead of Newton steps, and all scores."""
    marked = sorted((hashlib.md5(f"fit:{i}".encode()).digest(), i, t, int(i % 3 != 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 5)
    each = {q: [t.encode() for _, _, t, x in marked if x == q] for q in (0, 1)}

    def dictionary(texts):
        size = min(64 << 10, max(1024, sum(map(len, texts)) // 8))
        return zstandard.train_dictionary(size, texts).as_bytes()

    def difference(words, data):
        sizes = []
        for w in words:
            d = zstandard.ZstdCompressionDict(w)
            sizes.append(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(data)))
        return (sizes[1] - sizes[0]) / (len(data) + 16)

    x, y = [], []
    for k in (0, 1):
        words = [dictionary(each[q][1 - k :: 2]) for q in (1, 0)]
        for q in (0, 1):
            x += [difference(words, t) for t in each[q][k::2]]
            y += [q] * len(each[q][k::2])
    x, y = np.array(x), np.array(y, float)
    z = np.column_stack([np.ones(len(x)), x / x.std()])
    w = np.zeros(2)
    for _ in range(20000):  # gradient steps on the penalised likelihood
        w += 0.02 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) - 1e-2 * w)
    w /= [1, x.std()]
    share, have = count[1] / sum(count), y.mean()
    w[0] += np.log(share / (1 - share)) - np.log(have / (1 - have))
    words = [dictionary(each[q]) for q in (1, 0)]
    return {i: 1 / (1 + np.exp(-(w[0] + w[1] * difference(words, (t or "").encode())))) for i, t in docs}


def test_every_score(spark):
    rows, docs, labels = table(spark)
    inside = [(i, q) for i, q in ((r["doc_id"], r["quality"]) for r in labels.collect()) if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5]
    want = plain(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], [sum(q == k for _, q in inside) for k in (0, 1)])
    found = {r["doc_id"]: r["score"] for r in cq.classify(docs, labels).collect()}
    assert set(found) == set(want)
    for i in want:
        assert found[i] == pytest.approx(want[i], abs=1e-4), i


def test_bounds_of_the_sample(spark):
    _, docs, labels = table(spark)
    extra = spark.createDataFrame([(10_000 + i, 1) for i in range(20_000)], "doc_id long, quality int")
    few = cq.fit(docs, labels.union(extra), per_class=30)  # labels without documents take no place in the sample
    assert "weights" in few
    assert "weights" in cq.fit(docs, labels, per_class=30, most_bytes=30_000) and "weights" not in cq.fit(docs, labels, most_bytes=200)
    long = spark.createDataFrame([(i, "the river ran by the old house and nobody came " * 2000) for i in range(0, 240, 7)], "doc_id long, text string")
    assert cq.fit(docs.where("doc_id % 7 <> 0").union(long), labels) != cq.fit(docs.where("doc_id % 7 <> 0"), labels)  # long texts count
