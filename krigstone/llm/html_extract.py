"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a variable with two states, main text or not.  A node's potential
comes from its tag, the words of its class, id and role, and the length, links and punctuation of
its own text; a potential on each parent-child edge ties the states of neighbours.  Both are
trained by counting on labelled pages.  Sum-product messages, up from the leaves and down from the
root, give each node's exact marginal; a block belongs to the main text if its own is above half.

Inline elements are part of their block.  A block's text has its character references decoded and
white space turned into single spaces; empty blocks are left out; the others are joined in page
order by an empty line.

Defined results: a null or empty page has the empty text, so has a page without main blocks; badly nested
markup is closed where a browser would; a tag, comment or declaration that is cut off goes with all
behind it, so does raw text without an end tag; text and elements outside a body, also behind its end, belong
to the body, which opens by itself; repeated rows give repeated results; an empty table gives an empty result; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas textarea select option button audio video datalist noembed noframes".split())
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul ins center".split()
)
ENDS_P = BLOCKS - {"html", "body", "ins"}
#: An opening element of the key closes an open one of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What may stand in a head; any other tag, and text, ends it.
HEADS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of these in which HTML goes on, and tags that end svg and math elsewhere.
WITHIN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


def tokens(html: str):
    """Markup and text of a page, as browsers tell them apart: ("text", text), ("start", name, attributes, closed by a
    slash) or ("end", name).  Comments, declarations and what is cut off within a tag or comment have no token.

    A generator that is sent True after a start reads on as raw text, up to the end tag of that name.
    """
    at = begin = 0  # the next place to look at, and the start of the text before it
    n = len(html)
    while (found := html.find("<", at)) >= 0:
        after = html[found + 1 : found + 2]
        if after.isascii() and after.isalpha():
            end = _tag_end(html, found + 1)
            kind = "start"
        elif after == "/" and found + 2 < n:
            letter = html[found + 2]
            end = _tag_end(html, found + 2) if letter.isascii() and letter.isalpha() else html.find(">", found + 2) + 1
            kind = "end" if letter.isascii() and letter.isalpha() else "none"
        elif after in ("!", "?"):
            end, kind = _comment_end(html, found), "none"
        else:
            at = found + 1
            continue
        if begin < found:
            yield "text", unescape(html[begin:found])
        if end <= 0:
            return  # cut off within markup
        at = begin = end
        if kind == "start":
            name, attributes, slash = _tag(html, found + 1, end - 1)
            if (yield "start", name, attributes, slash):
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I | re.A).search(html, end)
                at = begin = close.start() if close else n
        elif kind == "end":
            yield "end", NAME.match(html, found + 2)[0].translate(LOWER)
    if begin < n:
        yield "text", unescape(html[begin:])


NAME = re.compile(r"[^\x20\t\n\r\f/>]+")
ATTRIBUTE = re.compile(r"[\x20\t\n\r\f/]*([^\x20\t\n\r\f/>][^\x20\t\n\r\f/>=]*)(?:[\x20\t\n\r\f]*=[\x20\t\n\r\f]*(\"|'|[^\x20\t\n\r\f>\"'][^\x20\t\n\r\f>]*)?)?")
LOWER = {c: c + 32 for c in range(65, 91)}


def _attributes(html: str, at: int):
    """(name, value) of a tag from behind its name on, and last (None, the place behind its end, or 0)."""
    while True:
        found = ATTRIBUTE.match(html, at)
        if not found:
            end = html.find(">", at)
            yield None, end + 1
            return
        value, at = found[2], found.end()
        if value in ('"', "'"):
            end = html.find(value, at)
            if end < 0:
                yield None, 0
                return
            value, at = html[at:end], end + 1
        yield found[1].translate(LOWER), value


def _tag_end(html: str, at: int) -> int:
    """The place behind the end of the tag whose name starts at a place; 0 if it is cut off."""
    name = NAME.match(html, at).end()
    close = html.find(">", name)
    if close < 0:
        return 0
    if not any(q in html[name:close] for q in "\"'"):
        return close + 1
    for key, value in _attributes(html, name):
        if key is None:
            return value
    return 0


def _tag(html: str, at: int, close: int) -> tuple[str, dict, bool]:
    """Name, attributes (the first of each name) and whether a slash ends it, of a tag up to its >."""
    name = NAME.match(html, at)
    found: dict[str, str] = {}
    if name.end() < close:
        for key, value in _attributes(html, name.end()):
            if key is not None:
                found.setdefault(key, unescape(value or ""))
    return name[0].translate(LOWER), found, html[close - 1] == "/"


def _comment_end(html: str, at: int) -> int:
    """The place behind a comment or declaration; 0 if it is cut off."""
    if not html.startswith("<!--", at):
        return html.find(">", at) + 1
    if html.startswith((">", "->"), at + 4):
        return html.index(">", at) + 1
    found = re.compile("--!?>").search(html, at + 4)
    return found.end() if found else 0


class Page:
    """Block nodes in page order (parents first), and runs of text with the node they belong to."""

    def __init__(self, html: str):
        self.tags, self.parents, self.words, self.labels = ["#root"], [-1], [()], [None]
        self.open = [("#root", 0)]  # names of open elements, with the node each is in
        self.places: dict[str, list[int]] = {}  # where those of each name are in open
        self.blocks = [0]  # where the open blocks are
        self.runs: list[tuple[int, int, bool, str]] = []  # node, block number, inside a link, text
        self.block, self.links, self.dropped = 0, 0, 0
        found = tokens(html)
        raw = None
        while True:
            try:
                kind, *rest = found.send(raw)
            except StopIteration:
                break
            raw = None
            if kind == "text":
                self._text(*rest)
            elif kind == "end":
                self._end(*rest)
            else:
                name, attributes, slash = rest
                foreign = any(self.places.get(f) for f in FOREIGN)
                self._start(name, attributes)
                # as browsers do, a slash closes svg, math and what they hold, but no other element
                if slash and self.open[-1][0] == name and (name in FOREIGN or foreign):
                    self._pop_to(len(self.open) - 1)
                else:
                    raw = name in RAW and (not foreign or name in ("script", "style"))

    def _start(self, tag, attributes):
        if self.dropped:
            if tag not in HEADS:
                self._end_head()
            while tag in BREAKS and self.open[-1][0] in FOREIGN:
                self._pop_to(len(self.open) - 1)
        if self.dropped:
            if tag in DROPPED or tag in WITHIN:
                self._push(tag, self.open[-1][1])
            return
        if tag in ("html", "body") and self.places.get(tag):
            return  # there is one of each
        if tag not in HEADS and tag not in ("html", "body"):
            self._in_body()
        if tag in ENDS_P and self.open[self.blocks[-1]][0] == "p":
            self._pop_to(self.blocks[-1])
        for name in CLOSES.get(tag, ()):
            self._close_within(name, HOLDS[tag])
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                self.runs.append((self.open[-1][1], self.block, False, "" if tag == "wbr" else " "))
            elif tag == "hr":
                self.block += 1
            return
        node = self.open[-1][1]
        if tag in BLOCKS:
            self.block += 1
            self.labels.append(attributes.get("data-main"))
            hidden = "hidden" in attributes or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or "")
            said = " ".join(attributes.get(k) or "" for k in ("class", "id", "role", "aria-label"))
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower())
            self.tags.append(tag)
            self.parents.append(node)
            self.words.append((*dict.fromkeys(words), *(["#hidden"] if hidden else [])))
            node = len(self.tags) - 1
        self._push(tag, node)

    def _end(self, tag):
        if tag in ("html", "body"):  # what follows is put back into the body
            self.block += 1
            return
        if tag == "br":
            self._start("br", {})
            return
        if not self.places.get(tag):
            self.block += tag == "p" and not self.dropped
            return
        at = self.places[tag][-1]
        if tag in BLOCKS or tag in DROPPED or at > self.blocks[-1]:  # an inline end tag doesn't close blocks
            self._pop_to(at)

    def _text(self, data):
        if data.strip():
            self._end_head()
            if not self.dropped:
                self._in_body()
        if not self.dropped and data:
            self.runs.append((self.open[-1][1], self.block, self.links > 0, data))

    def _end_head(self):
        if self.open[-1][0] == "head":
            self._pop_to(len(self.open) - 1)

    def _in_body(self):
        if not self.places.get("body"):
            self._start("body", {})

    def _push(self, tag, node):
        at = len(self.open)
        self.open.append((tag, node))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        self.links += tag == "a"
        self.dropped += tag in DROPPED

    def _pop_to(self, at):
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.links -= tag == "a"
            self.dropped -= tag in DROPPED
            self.block += tag in BLOCKS

    def _close_within(self, name, until):
        """Closes the last open element of a name, unless one of the others was opened after it."""
        last = lambda x: (self.places.get(x) or [-1])[-1]
        if last(name) > max(map(last, until)):
            self._pop_to(last(name))


def features(page: Page) -> list[list[str]]:
    n = len(page.tags)
    chars, linked, last = [0] * n, [0] * n, [""] * n
    for node, _, link, data in page.runs:
        size = len(data.strip())
        chars[node] += size
        linked[node] += size * link
        last[node] = data.rstrip()[-1:] or last[node]
    out = []
    for i in range(n):
        size = sum(chars[i] > x for x in (0, 25, 90, 250))
        share = linked[i] / chars[i] if chars[i] else -1
        links = "none" if share < 0 else str(sum(share > x for x in (0, 0.3, 0.7)))
        ends = "none" if not chars[i] else str(last[i] in '.!?:…»”"')
        out.append([f"tag:{page.tags[i]}:{'empty' if share < 0 else 'links' if share > 0.7 else 'text'}", f"size:{size}", f"links:{links}", f"ends:{ends}", *(f"word:{w}" for w in page.words[i])])
    return out


def edge_kind(page: Page, i: int) -> str:
    """Edges to nodes that are named (by class, id or role) or structural have potentials of their own."""
    if page.words[i]:
        return "named"
    return "plain" if page.tags[i] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "tr", "th", "table", "tbody", "thead", "blockquote", "pre", "dl", "dt", "dd", "figure", "figcaption") else "structural"


def label_counts(html: str) -> list[tuple[str, int, int]]:
    """(feature or edge, state, state of the parent or -1) of a labelled page: blocks with the
    attribute data-main=1 and what they hold are main text, those with data-main=0 are not."""
    page = Page(html)
    states = []
    for i, mark in enumerate(page.labels):
        states.append(int(mark) if mark in ("0", "1") else states[page.parents[i]] if i else 0)
    out = []
    for i, found in enumerate(features(page)):
        out += [(f, states[i], -1) for f in [*found, "any"]]
        if i:
            out.append((f"edge:{edge_kind(page, i)}", states[i], states[page.parents[i]]))
    return out


def train(pages: DataFrame) -> dict:
    """Potentials from pages(html) with labels in the markup.  The result is as large as the
    vocabulary of tags and class words of these pages."""

    def count(batches):
        for batch in batches:
            rows = [row for html in batch.column(0).to_pylist() for row in label_counts(html or "")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)], ["what", "state", "parent"])

    rows = pages.select("html").mapInArrow(count, "what string, state int, parent int").groupBy("what", "state", "parent").count().collect()
    table = {(r["what"], r["state"], r["parent"]): r["count"] for r in rows}
    total = [table.get(("any", s, -1), 0) for s in (0, 1)]
    nodes, edges = {}, {}
    for what in {k[0] for k in table if k[2] == -1 and k[0] != "any"}:
        nodes[what] = [math.log((table.get((what, s, -1), 0) + 0.5) / (total[s] + 1)) for s in (0, 1)]
    for kind in ("named", "plain", "structural"):
        have = [[table.get((f"edge:{kind}", s, p), 0) + 0.5 for s in (0, 1)] for p in (0, 1)]
        edges[kind] = [[math.log(x / sum(row)) for x in row] for row in have]
    return {"nodes": nodes, "edges": edges}


def _sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def marginals(page: Page, model: dict) -> list[float]:
    """Probability of main text for every node: one pass up, one pass down."""
    n = len(page.tags)
    own = []
    for found in features(page):
        each = [model["nodes"].get(f, (0.0, 0.0)) for f in found]
        own.append([sum(e[s] for e in each) for s in (0, 1)])
    # the page itself is not main text: a root that is would only repeat its children's evidence
    own[0][1] -= 20.0
    edges = [None] + [model["edges"][edge_kind(page, i)] for i in range(1, n)]
    belief = [list(x) for x in own]  # own potential and all messages from below
    up = [None] * n
    for i in range(n - 1, 0, -1):
        up[i] = [_sum(belief[i][0] + edges[i][p][0], belief[i][1] + edges[i][p][1]) for p in (0, 1)]
        for s in (0, 1):
            belief[page.parents[i]][s] += up[i][s]
    for i in range(1, n):  # parents come first and hold their full belief by now
        p = page.parents[i]
        rest = [belief[p][s] - up[i][s] for s in (0, 1)]
        for s in (0, 1):
            belief[i][s] += _sum(rest[0] + edges[i][0][s], rest[1] + edges[i][1][s])
        top = max(belief[i])
        belief[i] = [x - top for x in belief[i]]
    # messages were scaled above, so the root is scaled as well before it is read
    return [1 / (1 + math.exp(min(700.0, max(-700.0, b[0] - b[1])))) for b in belief]


def main_text(html: str | None, model: dict) -> str:
    page = Page(html or "")
    main = marginals(page, model)
    blocks: dict[int, list[str]] = {}
    for node, block, _, data in page.runs:
        if main[node] > 0.5:
            blocks.setdefault(block, []).append(data)
    found = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in found if b)


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [main_text(x, sent.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


# Labelled pages: layouts of many kinds, with the labels in the markup.

#: Usual elements and names of the parts of a page that are not main text.
REGIONS = {
    "menu": ("nav ul div", "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs skip links toc pagination pager"),
    "header": ("header div", "header masthead site banner logo topbar branding hero top"),
    "footer": ("footer div", "footer site copyright colophon bottom legal imprint foot"),
    "sidebar": ("aside div section", "sidebar side widget rail related recommended popular trending more secondary complementary"),
    "notice": ("div section dialog aside", "cookie cookies consent gdpr notice alert popup modal subscribe paywall overlay warning privacy"),
    "advert": ("div ins section aside", "ad ads advert advertisement adsense sponsor sponsored promo promotion banner commercial"),
    "form": ("form div fieldset", "form login signup newsletter search register contact"),
    "comments": ("section div ol ul", "comments comment discussion replies reply responses disqus thread reader feedback"),
    "share": ("div ul p", "share social follow tools buttons tags meta byline author date"),
}
MAIN = ("article main div section", "content post entry article main story body text primary page column prose")


def labelled_page(seed: int) -> str:
    rng = random.Random(seed)
    syllables = "ka lo mi ren tus vel dor sha ple nim or est ba qui zor".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 22))).capitalize() + rng.choice(".....?!")
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))
    link = lambda: f'<a href="/{word()}">{word()}</a>'

    every = sorted({w for _, names in REGIONS.values() for w in names.split()} | set(MAIN[1].split()))

    def named(names: str, often: float) -> str:
        if rng.random() > often:
            return ""
        said = "-".join(rng.sample(names.split(), rng.choice((1, 1, 2)))) + rng.choice(("", "", f" {word()}", "-wrapper", " box"))
        if rng.random() < 0.08:  # a name that says something else
            said += rng.choice("- ") + rng.choice(every)
        return f' {rng.choice(("class", "class", "id"))}="{said}"'

    def region(kind: str) -> str:
        tags, names = REGIONS[kind]
        tag = rng.choice(tags.split())
        sure = tag in ("nav", "header", "footer", "aside", "form", "ins", "dialog", "fieldset")
        items = rng.randint(1, 6)
        if kind in ("menu", "share") or rng.random() < 0.3:
            inner = "".join(f"<li>{link()}</li>" for _ in range(items))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "comments":
            each = [f'<div{named(names, 0.5)}><p>{prose()}</p></div>' if rng.random() < 0.6 else f"<p>{prose()}</p>" for _ in range(items)]
            inner = "".join(f"<li>{x}</li>" for x in each) if tag in ("ul", "ol") else "".join(each)
        elif kind == "form":
            inner = f"<label>{word()}</label><input name={word()}><p>{sentence()}</p><button>{word()}</button>"
        else:
            inner = rng.choice((prose(), f"<p>{prose()}</p>", f"<h3>{word()}</h3><p>{prose()}</p>", f"{word()} {link()} {sentence()}", f"<div>{link()}</div><p>{sentence()}</p>"))
        unseen = rng.choice((" hidden", ' style="display: none"', ' style="visibility:hidden"')) if rng.random() < 0.06 else ""
        if unseen:
            inner = rng.choice((inner, f"<p>{prose()}</p><p>{prose()}</p>"))
        return f'<{tag}{named(names, 0.6 if sure or unseen else 1)}{unseen} data-main="0">{inner}</{tag}>'

    def block() -> str:
        if rng.random() < 0.04:  # a part of the text under a name that would suit other parts
            return f'<{(t := rng.choice(("div", "section", "div")))} class="{rng.choice(every)}{rng.choice(("", "-free", "-zone", f"-{word()}", f" {word()}"))}"><p>{prose()}</p><p>{prose()}</p></{t}>'
        return rng.choice((
            lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}", lambda: f"<p>{prose()} {link()} {sentence()}</p>",
            lambda: f"<p>{sentence()}</p>", lambda: f"<p>{word()}</p>", lambda: f"<p><b>{sentence()}<br>", lambda: f"<h2>{word()} {word()}</h2>", lambda: f"<h3>{sentence()}</h3>",
            lambda: f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{rng.choice((sentence, word, link))()}</li>" for _ in range(3)) + f"</{t}>",
            lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<pre>{prose()}</pre>",
            lambda: "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence()}</td></tr>" for _ in range(2)) + "</table>",
            lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>", lambda: f"<div><p>{prose()}</p></div>", lambda: f"<section><h2>{word()}</h2><p>{prose()}</p></section>",
        ))()

    inner = [block() for _ in range(rng.randint(1, 12))]
    for _ in range(rng.choice((0, 0, 1, 2))):
        inner.insert(rng.randint(0, len(inner)), region(rng.choice(("advert", "share", "notice", "sidebar", "form"))))
    if rng.random() < 0.25:
        inner.append(region("comments"))
    title = f"<h1>{sentence()}</h1>" if rng.random() < 0.8 else ""
    before = [region(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [region(k) for k in ("comments", "sidebar", "advert", "notice", "footer", "share", "menu") if rng.random() < 0.5]
    rng.shuffle(before)
    head = f"<html><head><title>{word()}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
    layout = rng.random()
    if layout < 0.12:  # the text stands in the body itself, between other parts or alone
        sides = [[], []] if rng.random() < 0.4 else [before, after]
        body = "".join(sides[0]) + title + "".join(inner) + "".join(sides[1])
        return f'{head}<body{named(MAIN[1], 0.3)} data-main="1">{body}</body></html>'
    if layout < 0.17:  # without paragraphs
        return f'{rng.choice((head, ""))}<body data-main="1">' + rng.choice(("<br>", "<br><br>", " ")).join(prose() for _ in range(rng.randint(1, 5))) + rng.choice(("", "", f" <b>{word()}</b> {word()}", f"<br>{link()}", f"<br>{word()}")) + "</body></html>"
    if layout < 0.21:  # a table that lays out the page
        cells = [f'<td{named("menu nav links left right side", 0.5)} data-main="0">{rng.choice(("<br>", " | ", "<p>")).join(link() for _ in range(rng.randint(2, 8)))}</td>']
        cells.insert(rng.randint(0, 1), f'<td{named(MAIN[1], 0.5)} data-main="1">{title}{"".join(inner)}</td>')
        return f'{head}<body data-main="0"><table>{rng.choice(("", f"<tr><td data-main=0 colspan=2>{link()} {word()}</td></tr>"))}<tr>{"".join(cells)}</tr></table></body></html>'
    if layout < 0.25:  # elements without names
        around = lambda made: "".join(f"<div>{x}</div>" for x in made)
        menu = f'<div data-main="0">{rng.choice((around, " ".join, lambda made: around([" | ".join(made)])))([link() for _ in range(rng.randint(2, 8))])}</div>'
        written = f'<div data-main="1">{rng.choice((title, f"<div>{sentence()}</div>"))}{around(prose() for _ in range(rng.randint(1, 6)))}</div>'
        below = rng.choice(("", f'<div data-main="0">{around([link(), f"{word()} {word()}"])}</div>', f'<div data-main="0">{word()} {link()}</div>'))
        body = rng.choice((menu + written + below, written + menu + below))
        return f'{rng.choice((head, ""))}<body data-main="0">{rng.choice((body, f"<div>{body}</div>"))}</body></html>'
    tag = rng.choice(MAIN[0].split())
    main = f'<{tag}{named(MAIN[1], 0.5 if tag in ("article", "main") else 1)} data-main="1">{title}{"".join(inner)}</{tag}>'
    if layout < 0.29:  # more than one container
        main += f'<{tag}{named(MAIN[1], 0.5)} data-main="1">{"".join(block() for _ in range(3))}</{tag}>'
    body = "".join(before) + main + "".join(after)
    for _ in range(rng.choice((0, 1, 2))):
        body = f'<div{named("wrapper container page layout row grid outer", 0.7)} data-main="0">{body}</div>'
    return f'{head}<body data-main="0">{body}</body></html>'


def labelled_pages(spark: SparkSession, n: int = 1200) -> DataFrame:
    """n pages(page_id, html) of as many seeds."""

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([labelled_page(i) for i in batch.column(0).to_pylist()])], ["page_id", "html"])

    return spark.range(n, numPartitions=4).select(F.col("id").alias("page_id")).mapInArrow(make, "page_id long, html string")
