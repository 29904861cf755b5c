"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: what any match must hold.
The index keeps, for shards of documents, the posting list of each trigram that some query names; others are never
asked for. A rule's postings are intersected and united as its query says, and only its candidates are verified with
the expression itself. A rule without mandatory trigrams scans every text.

The shards bound the posting lists: a frequent trigram's documents are spread over all shards. Candidates join back to
the rows by id, which is spread evenly as well.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlens.llm.common import table, unpacked, whole

#: Documents in a shard of the index; strings that one stretch of an expression may stand for in a query.
SHARD_DOCS, MOST_STRINGS = 512, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length. The expression stays as
    it is where short matches hide later ones."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # The base expression is [0-9a-f]+ with 24 characters at least: the same spans, as a match takes a whole run.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
]

# A query is True, a trigram, or ("and" | "or", set of queries).
Query = bool | str | tuple


def _join(op: str, parts: list[Query]) -> Query:
    always = [p for p in parts if p is True]
    rest = {p for p in parts if p is not True}
    if op == "or" and (always or not rest):
        return True
    if not rest:
        return True
    if op == "or":  # what asks for more than another alternative adds nothing
        rest = {p for p in rest if not any(trigrams(o) < trigrams(p) for o in rest if _plain(o) and _plain(p))}
    return next(iter(rest)) if len(rest) == 1 else (op, frozenset(rest))


def _plain(query: Query) -> bool:
    return isinstance(query, str) or query is not True and query[0] == "and" and all(isinstance(q, str) for q in query[1])


def _of_strings(strings: set[str]) -> Query:
    each = [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in strings]
    return _join("or", each)


def trigram_query(pattern: str) -> Query:
    """What lower-cased trigrams a text with a match must hold. Stretches that stand for few strings give their
    trigrams; all else only ends a stretch."""
    from re import _constants as k
    from re import _parser

    def exact(item) -> set[str] | None:
        op, arg = item
        if op is k.LITERAL:
            return {chr(arg).lower()}
        if op is k.IN:
            found: set[str] = set()
            for what, x in arg:
                if what is k.LITERAL:
                    found.add(chr(x).lower())
                elif what is k.RANGE and x[1] - x[0] < 8:
                    found.update(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    return None
            return found if len(found) <= 8 else None
        if op is k.SUBPATTERN:
            return exact_all(arg[3])
        if op is k.BRANCH:
            parts = [exact_all(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[1] <= 2:
            one = exact_all(arg[2])
            if one is not None:
                return set().union(*({"".join(x) for x in _power(one, n)} for n in range(arg[0], arg[1] + 1)))
        return None

    def exact_all(items) -> set[str] | None:
        out = {""}
        for item in items:
            more = exact(item)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def _power(one: set[str], n: int) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [()]
        for _ in range(n):
            out = [x + (y,) for x in out for y in one]
        return out

    def query(items) -> Query:
        parts, stretch = [], {""}
        for item in items:
            more = exact(item)
            if more is not None and len(stretch) * len(more) <= MOST_STRINGS:
                stretch = {a + b for a in stretch for b in more}
                continue
            parts.append(_of_strings(stretch))
            stretch = {""} if more is None else more
            op, arg = item
            if more is None:
                if op is k.SUBPATTERN:
                    parts.append(query(arg[3]))
                elif op is k.BRANCH:
                    parts.append(_join("or", [query(b) for b in arg[1]]))
                elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
                    parts.append(query(arg[2]))
        return _join("and", [*parts, _of_strings(stretch)])

    return query(list(_parser.parse(pattern)))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _postings(query: Query, lists: Column) -> Column:
    """The ids of a shard that a query lets through."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<string>"))
    op = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(op, [_postings(q, lists) for q in sorted(query[1], key=str)])


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ids of the documents that rules must verify, with the rules as bits of mask. docs: key (string) and text."""
    asked = [(n, q) for n, q in ((n, trigram_query(r.pattern)) for n, r in enumerate(rules)) if q is not True]
    names = sorted(set().union(*(trigrams(q) for _, q in asked)))
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    low = docs.select(F.col("key"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in names)))
    terms = low.select("shard", "key", F.explode(held).alias("term"))
    lists = terms.groupBy("shard", "term").agg(F.collect_set("key").alias("ids"))
    index = lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("term", "ids"))).alias("lists"))
    each = F.array(*(F.struct(F.lit(1 << n).alias("bit"), _postings(q, F.col("lists")).alias("ids")) for n, q in asked))
    open_ = index.select(F.inline(each)).select("bit", F.explode("ids").alias("key"))
    return open_.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule's matches, leftmost first and not overlapping: struct of start, kind, end in code points. What
    lies between matches and the matches themselves give the places by sums, taken in blocks of about the root of
    their number, so that very many matches stay affordable."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else hits

    def add(a: Column, b: Column) -> Column:
        return a + b

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), add)

    def spans(x: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            block = F.floor(i / x["wide"]).cast("int")
            before = total(F.slice(x["sums"], F.lit(1), block)) + total(F.slice(x["steps"], block * x["wide"] + 1, i - block * x["wide"]))
            start = before + F.element_at(x["between"], i + 1)
            return F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind"), (start + hit).cast("long").alias("end"), F.element_at(x["counted"], i + 1).alias("size"))

        return F.filter(F.transform(x["hits"], span), lambda s: s["size"] >= rule.least)

    # Each step is bound to a name by a one-element array, so that nothing is evaluated twice.
    bound = F.array(F.struct(between.alias("between"), hits.alias("hits"), counted.alias("counted")))
    bound = F.transform(bound, lambda x: F.struct(x["between"], x["hits"], x["counted"], F.zip_with(F.slice(x["between"], 1, F.size(x["hits"])), x["hits"], add).alias("steps"), F.ceil(F.sqrt(F.size(x["hits"]))).cast("int").alias("wide")))
    bound = F.transform(bound, lambda x: F.struct(x["between"], x["hits"], x["counted"], x["steps"], x["wide"], F.transform(F.sequence(F.lit(0), x["wide"]), lambda b: total(F.slice(x["steps"], b * x["wide"] + 1, x["wide"]))).alias("sums")))
    return F.flatten(F.transform(bound, spans))


_EMPTY = "array<struct<start:bigint,kind:int,end:bigint,size:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, rules: list[Rule] | None = None) -> DataFrame:
    """Each row of docs: its id, with keep the whole row as struct `kept`, and `found`: the spans of all rules, ordered by
    start and then by the rule's place, each a struct of start, kind (place of the rule), end and size.

    A null text counts as empty and has no spans. Repeated rows each get their result; a null id is a key like
    others. Without keep, columns that are not asked for are not read."""
    rules = RULES if rules is None else rules
    own = [F.col(id_col).alias("id"), *([whole(docs).alias("kept")] if keep else [])]
    rows = docs.select(F.struct(*own).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"))
    rows = rows.join(candidates(rows.select("key", "text"), rules), "key", "left")
    text, mask = F.col("text"), F.coalesce("mask", F.lit(0))
    each = []
    for n, rule in enumerate(rules):
        full = trigram_query(rule.pattern) is True
        there = F.rlike(text, F.lit(rule.pattern)) if full else mask.bitwiseAND(F.lit(1 << n)) != 0
        each.append(F.when(there, _matches(text, rule, n)).otherwise(F.array().cast(_EMPTY)))
    out = rows.withColumn("found", F.array_sort(F.flatten(F.array(*each))))
    return out.select(F.col("own.id").alias(id_col), *(["own.kept"] if keep else []), "found")


def _listed(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The contract's columns from the operator's."""
    rules = RULES if rules is None else rules
    spans = F.col("found")
    count: Callable[[int], Column] = lambda n: F.size(F.filter(spans, lambda s: s["kind"] == n)).cast("long")
    base = [n for n, r in enumerate(rules) if r.base]
    return found.select(
        "doc_id", *(count(n).alias(f"n_{rules[n].kind}") for n in base),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"].isin(base)), rules), 256).alias("base_sha256"),
        _listed(spans, rules).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by a mark."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars kept true; texts without secrets stay as they
    are, null ones included. Repeated rows are treated each; an empty table stays empty."""
    found = scan_secrets(docs, keep=True)
    field = lambda c: F.col(f"kept.c{docs.columns.index(c)}")
    any_, text = F.size("found") > 0, redacted(field("text"), F.col("found"))
    new = {"text": F.when(any_, text).otherwise(field("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(any_, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return unpacked(found, docs, "kept", **new)
