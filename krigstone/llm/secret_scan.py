"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query: a conjunction of clauses, each a
choice between sets of trigrams of which all must occur.  The index has postings (trigram, doc_id) for
the trigrams that the rules ask for and a text contains, in lower case.
Intersecting the postings by document gives candidate (document, rule) pairs; only these are
searched with the rule itself.  Rules without mandatory trigrams scan every text.

Spans count code points, ends exclusive, and don't overlap within a kind; failing matches (group
or whole match too short) are dropped after matching, so they still use up their text.

Defined results: a null or empty text has no spans; an empty table gives an empty result;
repeated rows, also those that share a doc_id, get their own spans (the postings of one doc_id
are pooled, which only adds candidates); a null doc_id is a key of its own; other columns are
ignored by ``scan`` and carried by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, unused


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0


#: The first three are the base rules, in the order that sorts spans of one start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ with shorter matches dropped: matches are maximal runs
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
)
BASE = 3
#: A run of literal text is cut where it could be more strings than this.
MOST_STRINGS = 64
MASK = "[SECRET]"


def _strings(items) -> set[str] | None:
    """All strings that a parsed expression can match, lower-cased; None if too many or unknown."""
    out = {""}
    for op, value in items:
        if op is kinds.LITERAL:
            each = {chr(value).lower()}
        elif op is kinds.IN and value[0][0] is not kinds.NEGATE and all(o is kinds.LITERAL for o, _ in value):
            each = {chr(v).lower() for _, v in value}
        elif op is kinds.BRANCH:
            parts = [_strings(x) for x in value[1]]
            each = None if None in parts else set().union(*parts)
        elif op is kinds.SUBPATTERN:
            each = _strings(value[3])
        elif op is kinds.MAX_REPEAT and value[1] <= 2:
            inner = _strings(value[2])
            each = None if inner is None else {x * n for n in range(value[0], value[1] + 1) for x in inner}
        else:
            each = None
        if each is None or len(out) * len(each) > MOST_STRINGS:
            return None
        out = {x + y for x in out for y in each}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; a clause holds if all trigrams of one of its sets occur."""

    def clause(strings: set[str]) -> list[frozenset[str]]:
        if min(map(len, strings)) < 3:
            return []
        sets = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings}
        return sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)

    clauses, run = [], {""}
    for item in parser.parse(pattern):
        each = _strings([item])
        if each is not None and len(run) * len(each) <= MOST_STRINGS:
            run = {x + y for x in run for y in each}
            continue
        clauses.append(clause(run))
        run = {""} if each is None else each
        if each is None and item[0] is kinds.MAX_REPEAT and item[1][0] >= 1 and (inner := _strings(item[1][2])):
            run = inner  # at least one copy must be there, then anything
            clauses.append(clause(run))
            run = {""}
    clauses.append(clause(run))
    return [c for c in clauses if c]


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules ask for.

    A set of trigrams is looked for in order, up to the first that the text lacks: as all of a set must
    occur, the postings after that would not be intersected.
    """
    sets = sorted({tuple(sorted(s)) for r in rules for c in trigram_query(r.pattern) for s in c})
    low, none = F.lower("text"), F.array().cast("array<string>")

    def held(trigrams: tuple[str, ...]) -> Column:
        if not trigrams:
            return none
        return F.when(F.contains(low, F.lit(trigrams[0])), F.concat(F.array(F.lit(trigrams[0])), held(trigrams[1:]))).otherwise(none)

    found = F.array_distinct(F.flatten(F.array(*map(held, sets))))
    return texts(docs).select("doc_id", F.explode(found).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and the kinds whose trigram query its postings satisfy."""
    # a document has at most as many different postings as the rules have trigrams
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def satisfied(query) -> Column:
        out = F.lit(True)
        for c in query:
            any_of = F.lit(False)
            for s in c:
                all_of = F.lit(True)
                for t in sorted(s):
                    all_of = all_of & F.array_contains("held", t)
                any_of = any_of | all_of
            out = out & any_of
        return out

    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern))]
    found = F.array_compact(F.array(*(F.when(satisfied(q), F.lit(kind)) for kind, q in asked)))
    return held.select("doc_id", found.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end): the pieces between matches give the places of the matches."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    items = F.transform(
        F.arrays_zip(F.transform(matches, F.length).alias("n"), F.transform(counted, F.length).alias("c"), F.transform(F.slice(pieces, 1, F.size(matches)), F.length).alias("gap")),
        lambda x: x,
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["c"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def find_spans(docs: DataFrame, rules=RULES, name: str = "secret_spans") -> DataFrame:
    """docs with a column of sorted spans: array of (start, kind as a place in rules, end)."""
    key, kinds_ = unused(docs, "candidate_doc"), unused(docs, "candidate_kinds")
    found = candidates(build_index(docs, rules), rules).select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds_))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    each = []
    for k, rule in enumerate(rules):
        sought = F.array_contains(kinds_, rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        each.append(F.when(sought & text.rlike(rule.pattern), _spans(text, rule, k)).otherwise(none))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(key)), "left")
    return joined.select(*docs.columns, F.sort_array(F.concat(*each)).alias(name))


def _written(spans: Column, rules) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    return find_spans(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(count(k).alias(f"n_{rules[k].kind}") for k in range(BASE)),
        F.sha2(_written(base, rules).cast("binary"), 256).alias("base_sha256"), _written(spans, rules).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with every span (overlapping ones joined) replaced by MASK; n_chars follows, if there."""
    spans = unused(docs, "secret_spans")
    found = find_spans(docs, rules, spans)
    text = F.col("text")

    def add(acc, s):
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size(spans) > 0, whole).otherwise(text)
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def scan_sql(rules=RULES) -> str:
    """The same result in another engine's SQL, without an index."""
    def one(k: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""SELECT doc_id, row, {k} AS kind, i,
          (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::BIGINT AS start,
          length(found[i]) AS n, length(counted[i]) AS c
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT doc_id, row, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {rule.group}) AS counted,
                 string_split_regex(text, '{p}') AS pieces FROM docs WHERE regexp_matches(text, '{p}')))
        WHERE length(counted[i]) >= {rule.least}"""

    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    written = f"string_agg({names}[kind + 1] || ':' || start || ':' || (start + n), ',' ORDER BY start, kind)"
    return f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
    spans AS ({' UNION ALL '.join(one(k, r) for k, r in enumerate(rules))}),
    grouped AS (SELECT row, {', '.join(f"count(*) FILTER (WHERE kind = {k}) AS n_{rules[k].kind}" for k in range(BASE))},
      {written} FILTER (WHERE kind < {BASE}) AS base, {written} AS spans FROM spans GROUP BY row)
    SELECT doc_id, {', '.join(f"coalesce(n_{rules[k].kind}, 0)::BIGINT AS n_{rules[k].kind}" for k in range(BASE))},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN grouped USING (row)"""
