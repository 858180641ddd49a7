"""Chat formatting by quotation linking.

A message is split into its own text and quoted passages: runs of lines with the same number of
leading '>' signs.  Passages are normalised (letters and digits only, lower case) and hashed, whole
and by paragraph, line and sentence.  A passage's original is the earliest message of the conversation
whose own text, paragraph, line or sentence has that hash, if it is earlier than the quoting message.

A passage that has no original as a whole may be trimmed within a sentence or wrapped anew.  Its runs
of RUN words (what has fewer words is one run) are looked up among the runs of the own texts as well.
Of the earliest messages with each run the latest is the original, as common runs are met earlier too.

A message replies to the original of its passage with the lowest level, of these the one that is found
by the longest unit or run, of these the first.

Messages then come in reply order: threads by the turn of their first message, and within a thread
by turn, so that every message follows the one that it replies to.  Each is given without quotes and
attribution lines, in a chat template.

Originals are reduced to the earliest turn of each (conversation, hash) before they meet the quotes,
so neither a passage that many messages repeat nor a very long conversation makes pairs.

Defined results: a null or empty text is an empty message without quotes; a passage without letters
or digits, or without an earlier original, links to nothing; rows that repeat (conv_id, turn) count
as one place in the conversation and are all returned; a null conv_id or turn never links; a null role
is formatted as 'user'; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: Words of a run; Han and kana, which are written without spaces, count as words each.
RUN = 8
WORDS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
SENTENCES = re.compile(r"[.!?…]+[\"'”’»)\]]*(?:\s+|$)|[。！？]|\n\s*\n")
OMISSION = re.compile(r"\[?(?:\.\.\.|…)\]?")
#: A line such as 'On Monday, A wrote:' before a quotation, maybe with empty lines between.
ATTRIBUTION = re.compile(r"^.*\b(?:wrote|writes|said|schrieb|écrit|escribió)\b[^:]*:\s*$")


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text, and (level, passage) of each run of quoted lines."""
    own, passages, level = [], [], 0
    for line in (text or "").split("\n"):
        found = QUOTE.match(line)
        now = found[1].count(">") if found else 0
        body = line[found.end() :] if found else line
        if not now:
            own.append(body)
        else:
            at = len(own)
            while at and not own[at - 1].strip():
                at -= 1
            if not level and at and ATTRIBUTION.match(own[at - 1]):
                del own[at - 1 :]
            if now == level:
                passages[-1][1].append(body)
            else:
                passages.append((now, [body]))
        level = now
    return "\n".join(own).strip(), [(n, "\n".join(lines).strip()) for n, lines in passages]


def passage_key(passage: str) -> int | None:
    import xxhash

    plain = re.sub(r"[\W_]+", "", passage.lower())
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) - (1 << 63) if plain else None


def units(text: str) -> list[tuple[int, int]]:
    """(key, length) of the whole text, its paragraphs, its lines and its sentences; each key once."""
    out: dict[int, int] = {}
    for unit in (text, *re.split(r"\n\s*\n", text), *text.split("\n"), *SENTENCES.split(text)):
        key = passage_key(unit)
        if key is not None:
            out.setdefault(key, len(unit))
    return list(out.items())


def runs(text: str, n: int) -> list[tuple[int, int]]:
    """(key, letters but one) of each run of n words: less than the length of a unit of the same words."""
    import xxhash

    words = WORDS.findall(text.lower())
    each = (words[i : i + n] for i in range(len(words) - n + 1))
    return [(xxhash.xxh3_64_intdigest(" ".join(run).encode("utf-8", "replace"), 1) - (1 << 63), sum(map(len, run)) - 1) for run in each]


_QUOTES = "array<struct<level:int,place:int,size:int,key:bigint,whole:boolean>>"


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own text), units (keys of the own text), quotes."""
    quote = pa.struct([("level", pa.int32()), ("place", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("whole", pa.bool_())])
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("units", pa.list_(pa.int64())), ("quotes", pa.list_(quote))])

    def run(batches):
        for batch in batches:
            bodies, keys, quotes = [], [], []
            for text in batch.column(3).to_pylist():
                own, passages = split_quotes(text)
                bodies.append(own)
                keys.append([k for k, _ in units(own)])
                quotes.append([{"level": level, "place": i, "size": size, "key": key, "whole": key == passage_key(p)} for i, (level, p) in enumerate(passages) for key, size in units(p)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(keys, schema.field(4).type), pa.array(quotes, schema.field(5).type)], schema=schema)

    columns = messages.select("conv_id", "turn", "role", "text")
    return columns.mapInArrow(run, f"conv_id long, turn long, role string, body string, units array<long>, quotes {_QUOTES}")


def _quoted_runs(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, place, n (words), size and key of the runs of all passages."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("place", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, (level, passage) in enumerate(split_quotes(text)[1]):
                    for piece in OMISSION.split(passage):
                        n = min(RUN, len(WORDS.findall(piece.lower())))
                        rows += [(conv, turn, level, i, n, size, key) for key, size in (runs(piece, n) if n else ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return messages.select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, level int, place int, n int, size int, key long")


def _own_runs(parsed: DataFrame, lengths: list[int]) -> DataFrame:
    """conv_id, turn and key of the runs of the own texts, of each of these numbers of words."""

    def run(batches):
        for batch in batches:
            keys = [[k for n in lengths for k, _ in runs(body, n)] for body in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64()))], ["conv_id", "turn", "keys"])

    return parsed.select("conv_id", "turn", "body").mapInArrow(run, "conv_id long, turn long, keys array<long>").select("conv_id", "turn", F.explode("keys").alias("key"))


def _originals(own: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, key and parent: the earliest turn with a key that is quoted."""
    met = own.join(quotes.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    return materialize(met.groupBy("conv_id", "key").agg(F.min("turn").alias("parent")))


def link(parsed: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent and n_linked (passages with an original) of messages that quote others."""
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    quotes = materialize(quotes)
    originals = _originals(parsed.select("conv_id", "turn", F.explode("units").alias("key")), quotes)
    met = materialize(quotes.join(originals, ["conv_id", "key"]).where("parent < turn"))
    trimmed = quotes.where("whole and conv_id is not null and turn is not null").join(met, ["conv_id", "turn", "place", "key"], "left_anti")
    trimmed = materialize(trimmed.select("conv_id", "turn").distinct())
    met = met.select("conv_id", "turn", "level", "size", "place", "parent")
    if trimmed.limit(1).count():
        sought = materialize(_quoted_runs(messages.join(trimmed, ["conv_id", "turn"], "left_semi")))
        lengths = [r["n"] for r in sought.select("n").distinct().collect()]  # RUN numbers at most
        own = _own_runs(parsed.join(trimmed.select("conv_id").distinct(), "conv_id", "left_semi"), lengths)
        found = sought.join(_originals(own, sought), ["conv_id", "key"]).where("parent < turn")
        found = found.groupBy("conv_id", "turn", "level", "place").agg(F.max("size").alias("size"), F.max("parent").alias("parent"))
        met = met.unionByName(found)
    best = F.min(F.struct("level", (-F.col("size")).alias("size"), "place", "parent"))
    return met.groupBy("conv_id", "turn").agg(best.alias("best"), F.count_distinct("place").alias("n_linked")).select("conv_id", "turn", F.col("best.parent").alias("parent"), "n_linked")


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root and depth, by pointer doubling over conv_id, turn, parent."""
    state = materialize(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        state = materialize(
            state.join(above, ["conv_id", "root"], "left")
            .select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"))
        )
        if not state.where("moved").limit(1).count():
            return state.drop("moved")
        state = state.drop("moved")


def reply_ordered(messages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a message, sorted in reply order within each conversation: conv_id, thread (turn of
    its first message), turn, depth, parent_turn, role, n_quotes, n_linked, text, formatted."""
    parsed = materialize(parse(messages))
    links = materialize(link(parsed, messages))
    placed = links.join(roots(links), ["conv_id", "turn"])
    before, middle, after = re.match(r"(.*)\{role\}(.*)\{text\}(.*)", template, re.S).groups()
    formatted = F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(middle), F.col("body"), F.lit(after))
    n_quotes = F.size(F.array_distinct(F.transform("quotes", lambda q: q["place"]))).cast("long")
    out = parsed.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("root", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("parent").alias("parent_turn"), "role", n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("body").alias("text"), formatted.alias("formatted"),
    )
    # ranges of the whole order, so that a very long conversation spreads over several tasks
    return out.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
