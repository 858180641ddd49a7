"""Suffix dedup with a difference cover against all strings of the length, one by one."""

import random
from collections import Counter

import numpy as np
import pytest

from krigstone.llm import cover_dedup as cd


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(docs, length):
    return sorted((tuple(r)[:4] + (bytes(r["kept"]),) for r in cd.dedup(docs, length).collect()), key=str)


def corpus(n, length, seed=3):
    """Random texts, passages just below, at and above the length put into some, near and exact copies, runs of one letter."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh éж\n") for _ in range(k))
    passages = [word(length + d) for d in (-60, -9, -1, 0, 1, 2, 40, 75, 300, 900)]
    rows, last = [], word(1500)
    for i in range(n):
        kind = i % 8
        if kind == 0:
            text = word(rng.choice((0, 5, length // 2, 700)))
        elif kind in (1, 2):
            text = "".join(x for p in rng.sample(passages, 3) for x in (word(rng.choice((0, 1, 30, 200))), p))
        elif kind == 3:  # parts of two passages with what they have in common
            a, b = rng.sample(passages, 2)
            text = a[rng.randrange(50) :] + b[: rng.randrange(80, len(b))] + word(20)
        elif kind == 4:  # near copies of one text
            at = rng.randrange(len(last))
            text = last[:at] + rng.choice("xyz") + last[at + rng.randrange(2) :]
        elif kind == 5:
            text = last
        elif kind == 6:
            text = word(10) + rng.choice("ab") * rng.choice((length - 1, length, length + 1, 3 * length)) + word(10)
        else:
            text = (word(rng.choice((1, 7, 90))) * 40)[: rng.choice((length, 2 * length + 5, 1000))]
        rows.append((i, text))
    return rows


def test_the_cover():
    assert {(a - b) % cd.V for a in cd.COVER for b in cd.COVER} == set(range(cd.V))


@pytest.mark.parametrize(("length", "parts", "block", "chunk"), [(160, 1, 8 << 20, 1 << 20), (160, 4, 3000, 900), (400, 3, 20_000, 5000), (150, 2, 1, 1)])
def test_equals_the_plain_version(spark, monkeypatch, length, parts, block, chunk):
    monkeypatch.setattr(cd, "BLOCK", block)
    monkeypatch.setattr(cd, "CHUNK", chunk)
    rows = corpus(60 if block < 10 else 120, length, seed=length + parts)
    rows += [(1000, None), (1001, ""), (None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = plain(rows, length)
    assert sum(r[2] for r in want) > 0
    assert found(docs, length) == want


@pytest.mark.parametrize("alike", ["whole", "at first"])
def test_documents_somewhat_shorter_than_the_length(spark, alike):
    rng, length = random.Random(8), 160
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    texts = []
    for n in (length - 2, length - 1, length, length + 1, *range(length - cd.V, length - cd.V + 5)):
        text = word(n)
        texts += [text, text] if alike == "whole" else [text[:-1] + "x", text[:-1] + "y"]
    rows = list(enumerate([*texts, word(50), passage := word(300), passage + word(20)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # the first of the block is a short one
    got = found(docs, length)
    assert got == plain(rows, length)
    assert not any(r[2] for r in got if r[1] < length)


def test_odd_and_empty_tables(odd, nothing):
    assert found(odd, 400) == plain([(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 10**6], 400)
    assert found(nothing, 400) == []
    with pytest.raises(ValueError, match="bytes or more"):
        cd.dedup(nothing, 100)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(documents, 400) == plain(rows, 400)


def test_texts_are_not_moved_again(documents):
    blocks = cd._blocks(documents, 4)
    asked = cd._asked(blocks, None, 400, 4, 1)
    answers = asked.groupBy("bucket").applyInArrow(cd._answering(1), cd.ANSWER)
    plan = cd._asked(blocks, answers, 400, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in plan


def test_fingerprints_depend_on_the_string_only():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    data[3000:3600] = data[100:700]
    block = cd.Block(data, np.array([2000, 3000]), 400, 4)
    one, two = block.fingerprints(np.array([100, 3000, 3001]), np.array([700, 3600, 3600]))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2]
