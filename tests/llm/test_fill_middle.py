"""Fill-in-the-middle against a plain version, row by row."""

import hashlib
import random
import re

from krigstone.llm import fill_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units, digest = UNITS.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def made(n):
    rng = random.Random(11)
    letters = ["ab \n", "é ж\t字", "<P>SM ", "<>PSM", " \t\n\x0b\x0c\r", "x", "😀   y"]
    return [(i, "".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice((0, 1, 2, 3, 9, 60, 400))))) for i in range(n)]


def test_equals_the_plain_version(spark):
    rows = [*made(600), (7, "a <P"), (8, "> b"), (9, "<S"), (10, ">"), (None, "who owns this"), (601, None), (602, "word " * 30000), (602, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fill_middle.transform(docs).withColumn("back", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((plain(*r) for r in rows), key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_small_steps_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(made(200), "doc_id long, text string")
    want = sorted(map(str, fill_middle.transform(docs).collect()))
    monkeypatch.setattr(fill_middle, "STEP", 40)
    assert sorted(map(str, fill_middle.transform(docs).collect())) == want


def test_odd_and_empty_tables(odd, nothing):
    assert sorted(map(str, (tuple(r)[:6] for r in fill_middle.transform(odd).collect()))) == sorted(str(plain(r["doc_id"], r["text"])) for r in odd.collect())
    assert fill_middle.digests(nothing).count() == 0
