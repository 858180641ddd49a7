"""Page extraction, quotation linking, the pipeline and the queries of this folder."""

import os

import duckdb
import pytest

import corpus_pipeline
from krigstone.llm import html_extract, quotations
from krigstone.llm import queries as llm_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(html_extract.labelled_pages(spark, 400))


PAGES = {
    "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>First  par\nagraph.<p>Second <b>one</b><br>here.</article><footer>&copy; me</footer>": "T & U\n\nFirst par agraph.\n\nSecond one here.",
    "<body><div class='cookie-notice'><p>We use cookies.</p></div><div id=content class='post entry'><p>A long enough sentence of the text, with a comma.</p><ul><li>one thing.</li></ul></div><div class='sidebar widget'><p>Other things to read.</p></div>": "A long enough sentence of the text, with a comma.\n\none thing.",
    "<article><p>Text before the advert, as usual.</p><aside class=ad>Buy now.</aside><script>var a = '<p>no</p>';</script><p>Text after it.</p></article><section class=comments><p>Nice text.</p></section>": "Text before the advert, as usual.\n\nText after it.",
    "": "",
    "<p": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(model, html):
    assert html_extract.main_text(html, model) == PAGES[html]


HEAD = "<html><head><meta charset=utf-8><title>t</title>"
ARTICLE = "<article><h1>Of a title</h1><p>A long enough sentence of the text, with a comma.</p></article>"
#: Heads without an end tag, and drawings between the title and the sentence: all give the same text.
CLOSED_BY_BROWSERS = [
    f"{HEAD}<body>{ARTICLE}", f"{HEAD}<style>p{{}}</style>{ARTICLE}", f"{HEAD}<noscript><img src=x></noscript><body>{ARTICLE}", f"{HEAD}</head><body>{ARTICLE}",
    *(f"{HEAD}</head><body>{ARTICLE.replace('</h1>', f'</h1>{form}')}" for form in (
        "<svg width='1' />", "<math/>", "<svg><path d=x /><title/></svg>", "<svg><title>no</title><g><circle /></g>", "<svg><svg/>no</svg>", "<svg><desc><p>no</p></desc></svg>", "<svg><foreignObject><p>no</p></foreignObject></svg>")),
]


@pytest.mark.parametrize("html", CLOSED_BY_BROWSERS)
def test_heads_and_drawings(model, html):
    assert html_extract.main_text(html, model) == "Of a title\n\nA long enough sentence of the text, with a comma."


def test_marginals_are_exact(model):
    import itertools
    import math

    page = html_extract.Page("<body><div class=post><p>Some text, long enough.</p><p>x</p></div><nav><a>y</a></nav></body>")
    n = len(page.tags)
    own = [[sum(model["nodes"].get(f, (0.0, 0.0))[s] for f in found) for s in (0, 1)] for found in html_extract.features(page)]
    own[0][1] -= 20.0
    weight, total = [0.0] * n, 0.0
    for states in itertools.product((0, 1), repeat=n):
        score = sum(own[i][s] for i, s in enumerate(states))
        score += sum(model["edges"][html_extract.edge_kind(page, i)][states[page.parents[i]]][states[i]] for i in range(1, n))
        total += (p := math.exp(score))
        for i, s in enumerate(states):
            weight[i] += p * s
    assert html_extract.marginals(page, model) == pytest.approx([w / total for w in weight])


def test_page_frames(spark, model):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (2, None, "", 5), (3, "v", "<article><p>" + "Long text. " * 50000, 5)], "page_id long, url string, html string, text int")
    found = {r["page_id"]: r["n_chars"] for r in html_extract.extract(pages, model).collect()}
    assert found == {1: 0, 2: 0, 3: len("Long text. " * 50000) - 1}
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_quotes_are_parsed():
    own, quotes = quotations.split_quotes("On Monday, A wrote:\n> one\n> two\n>> three\nmine\n> four")
    assert own == "mine" and quotes == [(1, "one\ntwo"), (2, "three"), (1, "four")]
    assert quotations.split_quotes(None) == ("", [])
    assert quotations.passage_key("One, TWO!") == quotations.passage_key("one two") and quotations.passage_key("...") is None


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nAt noon?"), (1, 1, "user", "Other topic."), (1, 2, "assistant", "> At noon?\nYes."), (1, 3, None, "B wrote:\n> Yes.\n>> At noon?\nFine."),
        (1, 4, "user", "> other TOPIC\nI agree."), (1, 5, "user", "> unknown words\nHm."), (2, 0, "user", "> At noon?\nElsewhere."), (2, 1, "user", None), (2, 1, "user", ""), (None, 3, "user", "> Yes."), (3, None, "user", "x"),
    ]
    found = quotations.reply_ordered(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")).collect()
    assert len(found) == len(rows)
    first = [(r["turn"], r["parent_turn"], r["thread"], r["depth"], r["text"]) for r in found if r["conv_id"] == 1]
    assert first == [
        (0, None, 0, 0, "Shall we meet?\nAt noon?"), (2, 0, 0, 1, "Yes."), (3, 2, 0, 2, "Fine."), (1, None, 1, 0, "Other topic."), (4, 1, 1, 1, "I agree."), (5, None, 5, 0, "Hm."),
    ]
    assert [r["formatted"] for r in found if r["turn"] == 3 and r["conv_id"] == 1] == ["<|user|>\nFine.<|end|>\n"]
    assert quotations.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_attribution_before_an_empty_line():
    assert quotations.split_quotes("mine\nOn Monday, A wrote:\n\n> one\nmore") == ("mine\nmore", [(1, "one")])


def test_trimmed_quotes(spark):
    wrapped = "The committee met on the second floor of the old\nlibrary and after some hours of talk it had chosen\nneither of the plans that were laid before it. Nobody\nwas pleased."
    texts = [
        "First sentence here. Second sentence. A third one, longer.", wrapped, "Thanks. Yesterday they talked.", "> Second sentence.\nWhy?", "> The committee met on the\n> second floor of the old library and after some\n> hours of talk it had\nReally?",
        "> neither of the\n> plans\nWhich?", "> it had chosen [...] Nobody was\nI was.", "> yes\nWhat?", "> chosen one of the plans that were never laid before anybody\nNo.", "> laid before it. Thanks.\nSo.",
        "> the plans that were laid before it. Nobody was pleased. Thanks.\nSo.", "We read that the committee met on the second floor of the old house.", "> We read that the committee met on the second floor of\n> the old\nYes.",
    ]
    found = quotations.reply_ordered(spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    parents = {r["turn"]: r["parent_turn"] for r in found}
    assert parents == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 1, 6: 1, 7: None, 8: None, 9: 2, 10: 1, 11: None, 12: 11}
    assert sorted(r["turn"] for r in found if r["thread"] == 1) == [1, 4, 5, 6, 10]


def test_long_chains(spark):
    rows = [(1, i, "user", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(40)]
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["turn"], r["thread"], r["depth"]) for r in found] == [(i, 0, i) for i in range(40)]


def plain_replies(messages):
    """(conv_id, turn) -> (own text, parent, number of passages, of linked ones), by comparing every passage with
    every earlier message; messages: (conv_id, turn, text), whole passages or units only."""
    import re

    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    ends = re.compile(r"[.!?…]+[\"'”’»)\]]*(?:\s+|$)|[。！？]|\n\s*\n")
    parts = lambda x: [x, *re.split(r"\n\s*\n", x), *x.split("\n"), *ends.split(x)]
    out, by_conv = {}, {}
    for conv, turn, text in messages:
        by_conv.setdefault(conv, []).append((turn, text or ""))
    for conv, rows in by_conv.items():
        earlier = []  # (turn, normalised units)
        for turn, text in sorted(rows):
            own, passages = [], []
            for line in text.split("\n"):
                signs = re.match(r"[ \t]*((?:>[ \t]?)*)", line)
                level, body = signs[1].count(">"), line[signs.end() :] if ">" in signs[1] else line
                if level and passages and passages[-1][2] and passages[-1][0] == level:
                    passages[-1][1].append(body)
                elif level:
                    if own and not (passages and passages[-1][2]) and own[-1].endswith("wrote:"):
                        own.pop()
                    passages.append([level, [body], True])
                else:
                    if passages:
                        passages[-1][2] = False
                    own.append(body)
            met = []
            for place, (level, lines, _) in enumerate(passages):
                best = {}
                for unit in parts("\n".join(lines).strip()):
                    if (key := plain(unit)) and key not in best:
                        best[key] = len(unit)
                for key, size in best.items():
                    parent = next((t for t, units in earlier if key in units), None)
                    if parent is not None:
                        met.append((level, -size, place, parent))
            body = "\n".join(own).strip()
            out[conv, turn] = body, min(met)[3] if met else None, len([1 for _, lines, _ in passages if True]), len({m[2] for m in met})
            earlier.append((turn, {plain(u) for u in parts(body)}))
    return out


def test_replies_equal_brute_force(spark):
    """Conversations with quotations in three of four later turns."""
    made = llm_queries.quoting(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    want = plain_replies([(r["conv_id"], r["turn"], r["text"]) for r in made])
    found = quotations.reply_ordered(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(made) and sum(r["n_linked"] for r in found) > len(made) / 3 and max(r["depth"] for r in found) > 1
    got = {(r["conv_id"], r["turn"]): (r["text"], r["parent_turn"], r["n_quotes"], r["n_linked"]) for r in found}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]
    # threads in order: a message follows its parent
    seen = set()
    for r in sorted(found, key=lambda r: (r["conv_id"], r["thread"], r["turn"])):
        assert r["parent_turn"] is None or (r["conv_id"], r["parent_turn"]) in seen
        seen.add((r["conv_id"], r["turn"]))


def test_a_passage_that_all_quote(spark):
    """One conversation in which 4000 messages quote the first one."""
    opening = "The plan is to meet at the old bridge at noon. Bring the long rope."
    rows = [(7, 0, "user", opening)] + [(7, i, "user", f"> {opening}\nanswer {i}") for i in range(1, 4001)]
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 4001 and all(r["parent_turn"] == 0 and r["text"] == f"answer {r['turn']}" for r in found if r["turn"])


def test_long_attributions():
    name = "A person with a very long name, " * 20
    assert quotations.split_quotes(f"{name} wrote on Monday:\n> one\nmore") == ("more", [(1, "one")])


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_against_sql(spark, name):
    found = llm_queries.queries()[name](spark, SMALL)
    base = duckdb.connect()
    for file in os.listdir(SMALL):
        base.execute(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    want = base.execute(llm_queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in out.select("doc_id").collect()}
        out = corpus_pipeline.materialize(stage(spark, out, SMALL))
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before
    tokens = corpus_pipeline.STAGES[-1][1](spark, out, SMALL)
    assert tokens.count() == out.count() > 0 and tokens.where("size(ids) = 0").count() == out.where("text = ''").count()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SMALL).collect()}
    assert len(good & kept) >= 0.95 * len(good)
