"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold: an AND of
ORs of trigram sets. The index holds, for each trigram that some query names, the documents with it (letters
lower-cased). A query intersects and joins those postings to candidate documents, and the expression runs on
candidates alone. A rule without mandatory trigrams runs on every document.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRINGS = 64
MOST_CHARS = 8  # a character class of more is taken as unknown

Query = frozenset[frozenset[str]]  # alternatives, each a set of trigrams of which all must be there
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """``base`` rules count into the base columns. Matches count where group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: Kinds, patterns and lengths of the first three are fixed by contract; the others are the public forms of such keys.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


def trigram_query(pattern: str) -> Query:
    """What any match of ``pattern`` must hold, in lower case. ``ANY`` if nothing is mandatory."""
    strings, query = _needs(parser.parse(pattern))
    return _simple(_both(query, _of_strings(strings)) if strings is not None else query)


def _of_strings(strings: frozenset[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    return _simple(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= 256 else min(a, b, key=len)


def _simple(query: Query) -> Query:
    """Without alternatives that ask for more than another one."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _needs(parsed) -> tuple[frozenset[str] | None, Query]:
    """(all strings it can match, lower-cased, or None if too many; what a match must hold)."""
    whole, query, run = True, ANY, frozenset([""])
    for kind, value in parsed:
        strings, need = _need(kind, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query, whole = _both(query, _of_strings(run)), False
        if strings is not None and len(strings) <= MOST_STRINGS:
            run = strings
        else:
            query, run = _both(query, need), frozenset([""])
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def _need(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is kinds.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if kind is kinds.IN:
        chars: set[str] = set()
        for what, which in value:
            if what is kinds.LITERAL:
                chars.add(chr(which).lower())
            elif what is kinds.RANGE and which[1] - which[0] < MOST_CHARS:
                chars |= {chr(c).lower() for c in range(which[0], which[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= MOST_CHARS else (None, ANY)
    if kind is kinds.SUBPATTERN:
        return _needs(value[-1])
    if kind is kinds.BRANCH:
        parts = [_needs(part) for part in value[1]]
        if all(strings is not None for strings, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return frozenset().union(*(s for s, _ in parts)), ANY
        return None, _simple(frozenset().union(*(_of_strings(s) if s is not None else q for s, q in parts)))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _needs(body)
        if strings is not None and high is not kinds.MAXREPEAT and high <= 3:
            made, power = set() if low else {""}, {""}
            for times in range(1, int(high) + 1):
                power = {a + b for a in power for b in strings}
                if len(power) > MOST_STRINGS:
                    return None, _of_strings(strings) if low else ANY
                made |= power if times >= low else set()
            return frozenset(made), ANY
        return None, (_of_strings(strings) if strings is not None else query) if low else ANY
    if kind is kinds.AT:
        return frozenset([""]), ANY
    return None, ANY


def build_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (``gram``, ``id``) of the given trigrams."""
    low = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("low")).where("low is not null")
    held = F.array(*[F.when(F.contains("low", F.lit(gram)), F.lit(gram)) for gram in grams])
    return low.select("id", F.explode(F.array_compact(held)).alias("gram")).select("gram", "id")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``id`` and the ``kinds`` whose query its postings satisfy."""
    clauses = [(kind, number, len(grams), gram) for kind, query in queries.items() for number, grams in enumerate(query) for gram in grams]
    each = [F.struct(*[F.lit(value).alias(name) for name, value in zip(("kind", "clause", "size", "gram"), row)]) for row in clauses]
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*each)))  # as small as the rules
    met = index.join(F.broadcast(wanted), "gram").groupBy("id", "kind", "clause").agg(
        F.countDistinct("gram").alias("n"), F.first("size").alias("size")
    )
    return met.where("n = size").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """The rule's matches as structs (start, order, end, kind). Texts between matches give the places."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(found.alias("m"), tested.alias("g"), F.slice(between, 1, F.size(found)).alias("b"))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(x["g"]) >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(steps, start, step, lambda done: done["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_<kind>`` of the base rules, ``base_sha256`` (of the base spans),
    ``spans`` (all), ``n_spans``. A span is ``kind:start:end`` in code points, end exclusive; spans are ordered by start,
    then by the order of the rules, and joined by commas.

    A null text counts as empty; a text without secrets has no spans and the digest of the empty string. Ids are
    integers and may be null or repeat: a rule's candidates are ids, so each row of an id is verified by itself.
    Other columns are ignored. An empty table gives an empty result.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if frozenset() not in query}
    grams = sorted({gram for query in indexed.values() for grams in query for gram in grams})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if grams:
        found = candidates(build_index(docs, grams, id_col, text_col), indexed)
        found = found.select(F.col("id").alias("of"), "kinds").hint("shuffle_hash")
        rows = rows.join(found, rows["id"].eqNullSafe(found["of"]), "left").drop("of")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True)
        parts.append(F.when(asked & F.col("text").rlike(rule.pattern), _spans(rule, order, F.col("text"))).otherwise(none))
    rows = rows.select("id", *[part.alias(f"s{order}") for order, part in enumerate(parts)])

    def joined(of: list[int]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"s{order}") for order in of]))
        return F.concat_ws(",", F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = [order for order, rule in enumerate(rules) if rule.base]
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(f"s{order}").cast("long").alias(f"n_{rules[order].kind}") for order in base],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(list(range(len(rules)))).alias("spans"),
        reduce(lambda a, b: a + b, [F.size(f"s{order}") for order in range(len(rules))]).cast("long").alias("n_spans"),
    )
