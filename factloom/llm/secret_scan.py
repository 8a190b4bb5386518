"""Secret scans by a trigram inverted index; DataFrame and SQL functions only.

Each rule is a regular expression.  A Boolean query over lower-case trigrams is derived from it on the driver: a text
with a match must satisfy it.  The index holds, per trigram that some query names and per block of rows, the keys of
the rows whose text has it (a block bounds every posting list, however common the trigram).  Queries are
evaluated on the lists of a block by intersection and union; rows found are candidates, and only they are searched
with the expression.  A rule without mandatory trigrams is a candidate everywhere.

A row's key is a hash of its id and text: rows that share a key only add candidates, and candidates are verified.
Spans come from the matches and the pieces between them, whose lengths are summed in runs, so that a text with
many matches costs no square of their number.

Defined cases: null text counts as empty and has no spans; doc_id may be null or repeat, each row keeps
its own spans; texts are searched whole; equal spans of two rules are both listed; an empty table has no rows;
other columns are not looked at.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, whole

#: Most strings that a part of an expression is spelled out to, most characters of a class.
STRINGS, CLASS = 200, 8
#: Rows of a posting block, and lengths summed in one run.
BLOCK, RUN = 4096, 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` and the least length of a match (of group 2 where ``group``)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The kinds that the query's contract names.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
]
#: Published shapes of keys and tokens.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("url_password", r"://[A-Za-z0-9_.-]+:[^\x00-\x20/@:]+@", 12),
]
RULES = BASE + MORE

#: A query is None (every text), or a frozenset of alternatives, each a frozenset of trigrams that must all be there.
Query = frozenset[frozenset[str]] | None


# ---------------------------------------------------------------- trigram queries of expressions
def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least({x | y for x in a for y in b})


def _least(found: set[frozenset[str]]) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(x for x in found if not any(y < x for y in found))


def _of_strings(strings: set[str]) -> Query:
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in found else _least(found)


def _spelled(node: tuple) -> set[str] | None:
    """All strings of a node in lower case, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        chars = {chr(c).lower() for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], v[1] + 1))}
        return chars if len(chars) <= CLASS else None
    if kind is op.SUBPATTERN:
        return _strings_of(value[3])
    if kind is op.BRANCH:
        parts = [_strings_of(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 3 and value[0] != value[1] or kind is op.MAX_REPEAT and value[0] == value[1] <= 8:
        one, out = _strings_of(value[2]), set()
        if one is None:
            return None
        for n in range(value[0], value[1] + 1):
            made = {""}
            for _ in range(n):
                made = {a + b for a in made for b in one}
            out |= made
        return out if len(out) <= STRINGS else None
    return None


def _strings_of(nodes) -> set[str] | None:
    made = {""}
    for node in nodes:
        part = _spelled(node)
        if part is None or len(part) * len(made) > STRINGS:
            return None
        made = {a + b for a in made for b in part}
    return made


def _of_nodes(nodes) -> Query:
    """Runs of spelled-out nodes give trigrams; what cannot be spelled out ends a run and may add a query of its own."""
    query, run = None, {""}
    for node in nodes:
        part = _spelled(node)
        if part is not None and len(part) * len(run) <= STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query, run = _both(query, _of_strings(run)), part or {""}
        if part is None:
            query = _both(query, _of_node(node))
    return _both(query, _of_strings(run))


def _of_node(node: tuple) -> Query:
    kind, value = node
    if kind is op.SUBPATTERN:
        return _of_nodes(value[3])
    if kind is op.MAX_REPEAT and value[0] > 0:
        return _of_nodes(value[2])
    if kind is op.BRANCH:
        parts = [_of_nodes(p) for p in value[1]]
        return None if None in parts else _least(set().union(*parts))
    return None


def trigrams_of(pattern: str) -> Query:
    """The trigram query of an expression; None where it has no mandatory trigrams."""
    return _of_nodes(parser.parse(pattern))


# ---------------------------------------------------------------- index and candidates
def index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """``(block, gram, keys)`` of ``rows(key, block, text)``: the posting lists of ``grams``."""
    low = rows.select("key", "block", F.lower("text").alias("low"))
    has = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    postings = low.select("key", "block", F.explode(F.array_compact(F.array(*has))).alias("gram"))
    return postings.groupBy("block", "gram").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most a block's rows


def _of_rule(keys: Column, rule: int) -> Column:
    return F.transform(keys, lambda key: F.struct(key.alias("key"), F.lit(rule).alias("rule")))


def candidates(postings: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``(key, rules)``: rows that satisfy the queries of rules, with those rules' numbers."""
    none = F.array().cast("array<long>")
    block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))

    def every(grams: frozenset[str]) -> Column:
        found = None
        for g in sorted(grams):
            keys = F.coalesce(F.try_element_at("lists", F.lit(g)), none)
            found = keys if found is None else F.array_intersect(found, keys)
        return found

    hits = []
    for rule, query in queries.items():
        found = None
        for grams in sorted(query, key=sorted):
            found = every(grams) if found is None else F.array_union(found, every(grams))
        hits.append(_of_rule(found, rule))
    pairs = block.select(F.explode(F.concat(*hits)).alias("hit")).select("hit.*")
    return pairs.groupBy("key").agg(F.collect_set("rule").alias("rules"))


# ---------------------------------------------------------------- spans
def _before(lengths: Column) -> Column:
    """Per element the sum of those before it; runs of ``RUN`` are summed first, so that long arrays stay cheap."""
    none = F.array().cast("array<int>")

    def scan(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), none.alias("seen"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["seen"], F.array(a["sum"])).alias("seen")))["seen"]

    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    runs = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(RUN)), lambda i: F.slice(lengths, i, F.lit(RUN)))).otherwise(F.array().cast("array<array<int>>"))
    firsts = scan(F.transform(runs, total))
    return F.flatten(F.zip_with(runs, firsts, lambda run, first: F.transform(scan(run), lambda x: x + first)))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """``array<struct<start, rule, end>>`` of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    tree = parser.parse(rule.pattern)
    if rule.least and len(tree) == 1 and rule.pattern.endswith("]+"):  # of runs of one class only the long ones need be found
        pattern = F.lit(f"{rule.pattern[:-1]}{{{rule.least},}}")
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(hits, F.char_length)
    long = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    steps = F.zip_with(gaps, sizes, lambda gap, size: gap + F.coalesce(size, F.lit(0)))
    made = F.transform(
        F.arrays_zip(_before(steps).alias("past"), gaps.alias("gap"), sizes.alias("size"), long.alias("long")),
        lambda x: F.struct((x["past"] + x["gap"]).alias("start"), F.lit(number).alias("rule"), (x["past"] + x["gap"] + x["size"]).alias("end"), x["long"].alias("long")),
    )
    fit = F.filter(made, lambda x: F.coalesce(x["long"] >= rule.least, F.lit(False)))
    return F.transform(fit, lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``(doc_id, spans)`` per row of ``docs(doc_id, text)``: ``array<struct<start, rule, end>>`` in order, code points, end exclusive."""
    text = whole(F.col("text"))
    key = F.xxhash64("doc_id", text)
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigrams_of(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for grams in q for g in grams})
    if grams:
        # rows of a block stand together in the input, so a block has at most a file's rows and none is shared by two tasks
        place = F.monotonically_increasing_id()
        postings = kept(index(rows.withColumn("block", F.floor(place / BLOCK)), grams), "trigram-postings")
        found = kept(candidates(postings, queries), "trigram-candidates")
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    none = F.array().cast("array<struct<start: int, rule: int, end: int>>")
    parts = []
    for i, rule in enumerate(rules):
        made = _spans(F.col("text"), i, rule)
        wanted = F.array_contains("rules", i) if i in queries else F.col("text").rlike(rule.pattern)
        parts.append(F.when(F.coalesce(wanted, F.lit(False)), made).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column, rules: list[Rule] = RULES) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, rule: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == rule)).cast("long")


# ---------------------------------------------------------------- check
def _spelled_case(pattern: str) -> str:
    """The case-insensitive group with its ASCII letters spelled in either case, as engines differ in what else they fold."""
    found = pattern
    while "(?i:" in found:
        at = found.index("(?i:")
        end = found.index("))", at) + 1
        inner = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in found[at + 4 : end])
        found = found[:at] + inner + found[end + 1 :]
    return found


def check_sql(rules: list[Rule] = RULES) -> str:
    """The same spans by full scans in DuckDB."""
    parts = []
    for i, r in enumerate(rules):
        quoted = _spelled_case(r.pattern).replace("'", "''")
        parts.append(f"""SELECT doc_id, row, {i} AS rule, '{r.kind}' AS kind, regexp_extract_all(t, '{quoted}') AS hits, [length(x) FOR x IN regexp_extract_all(t, '{quoted}', {r.group})] AS long,
            string_split_regex(t, '{quoted}') AS gaps, {r.least} AS least FROM body""")
    return f"""
    WITH body AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
         found AS ({" UNION ALL ".join(parts)}),
         each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found WHERE len(hits) > 0),
         span AS (SELECT row, rule, kind, length(array_to_string(gaps[1:k], '')) + length(array_to_string(hits[1:k - 1], '')) AS a, length(hits[k]) AS n FROM each WHERE long[k] >= least),
         said AS (SELECT row, rule, a, kind || ':' || a || ':' || (a + n) AS s FROM span),
         joined AS (SELECT row, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
                           string_agg(s, ',' ORDER BY a, rule) FILTER (rule < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY a, rule) AS spans FROM said GROUP BY row)
    SELECT b.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM body b LEFT JOIN joined USING (row)
    """
