"""Token alignment against a plain version with the libraries themselves, and the parts that texts are split into."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from krigstone.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    return one, two


def spelt_a(tokenizer, i):
    letters = ta.byte_letters()
    return bytes(letters[c] for c in tokenizer.id_to_token(i))


def spelt_b(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def plain(rows, libraries):
    """Token by token, pair by pair."""
    one, two = libraries
    linked, out = [], []
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        words = [[spelt_a(one, i) for i in a], [spelt_b(two, i) for i in b]]
        if b"".join(words[0]) != whole or b"".join(words[1]) != whole:
            a = b = ()
            words = [[], []]
        ranges = []
        for side in words:
            at, each = 0, []
            for w in side:
                each.append((at, at + len(w)))
                at += len(w)
            ranges.append(each)
        pairs = [(a[i], b[j]) for i, x in enumerate(ranges[0]) for j, y in enumerate(ranges[1]) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, each, strict=True) if low <= s and e <= cut) for ids, each in zip((a, b), ranges, strict=True)))
            low = cut
        linked.append(pairs)
        out.append([doc_id, len(a), len(b), len(groups), len(pairs), None, None, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for pairs in linked for p in set(pairs))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    for row, pairs in zip(out, linked, strict=True):
        row[5], row[6] = sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs)
    return sorted(map(str, map(tuple, out)))


def made(n, seed=7):
    rng = random.Random(seed)
    letters = ["ab cd  ", "the of and in  ", "é ß ж 字 ", "\n\t x  \x00", "0123, .\n ", "<s>unk/ 0x41> <|endoftext|>", "😀👍🏽 a", "▁ a", "  "]
    return [(i, "".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice((1, 2, 3, 9, 40, 150))))) for i in range(n)]


def found(docs):
    return sorted(str(tuple(r)) for r in ta.align(docs, A, P.PATTERN, B).collect())


def test_equals_the_plain_version(spark, libraries):
    rows = [*made(150), (150, None), (151, ""), (None, "no id here"), (3, "an id again"), (3, "an id again"), (152, "<s> </s> <|endoftext|> <0x41>"), (153, " "), (154, "a" * 2000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows, libraries)


def test_many_blocks_and_a_short_memory_give_the_same(spark, libraries, monkeypatch):
    rows = made(120, 8)
    monkeypatch.setattr(ta, "STEP", 300)
    monkeypatch.setattr(ta, "BLOCK", 900)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows, libraries)
    a = ta.byte_level(A, P.PATTERN)
    want = [a.tokens([t for _, t in rows[i : i + 5]])[0].tolist() for i in range(0, 100, 5)]
    monkeypatch.setattr(ta, "MEMO", 3)
    assert [a.tokens([t for _, t in rows[i : i + 5]])[0].tolist() for i in range(0, 100, 5)] == want


def test_odd_and_empty_tables(odd, nothing, libraries):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 10000]
    assert found(odd.where("text is null or length(text) < 10000")) == plain(rows, libraries)
    assert len(found(odd)) == odd.count()
    assert found(nothing) == []


def test_parts_are_encoded_as_the_whole(libraries):
    one, two = libraries
    a, b, rng = ta.byte_level(A, P.PATTERN), ta.pieces(B), random.Random(9)
    texts = [t for _, t in made(1500, 10)] + ["".join(chr(rng.randrange(1, 0x3000)) if rng.random() < 0.7 else " " for _ in range(30)) for _ in range(500)]
    for text in texts:
        assert a.tokens([text])[0].tolist() == one.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert b.tokens([text])[0].tolist() == two.encode(text), text


def test_words_of_the_documents(documents, libraries):
    one, two = libraries
    a, b = ta.byte_level(A, P.PATTERN), ta.pieces(B)
    for r in documents.limit(60).collect():
        if r["text"]:
            assert a.tokens([r["text"]])[0].tolist() == one.encode(" " + r["text"], add_special_tokens=False).ids
            assert b.tokens([r["text"]])[0].tolist() == two.encode(r["text"])
