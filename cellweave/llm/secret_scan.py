"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression, of which :func:`mandatory` derives what any match must hold: a list of clauses, each a set of
literals of which one must stand in the match. A literal holds if its trigrams do, so a rule's Boolean trigram query is an AND over
clauses of an OR over literals of an AND over trigrams, all lower-cased. The index holds a posting (trigram, document)
for every trigram that a query names; a rule's candidates are the documents whose postings satisfy its query, found by
intersecting postings per document, and only candidates are verified with the expression. A rule without a mandatory literal of
three characters (long hexadecimal runs) has no query and scans every document.

A span is given in code points, end exclusive. Matches of a rule are leftmost and non-overlapping; spans whose checked group
is too short are dropped after matching, as they still use up the text they matched. Positions are running sums of the lengths of
matches and of the pieces between them, in blocks, so a text with many spans takes time in proportion. Rules beyond the
base three add spans and never remove one.

Defined results: null and empty texts have no spans, and every input row gets a result row; repeated rows each get theirs
(ids need not be unique and may be null: hits are joined by id and the text's hash). Ties in start order as the rules are listed.
Texts are scanned whole, whatever their length; an empty table gives an empty one; only the named columns are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored


MOST = 8  # alternatives of one part of an expression that literals are built from; a part with more ends them
BLOCK = 256  # elements of one block of a running sum


def parts(tree) -> list[set[str] | None]:
    """What each part of a concatenation matches: a few strings, lower-cased, or None for anything else."""
    out: list[set[str] | None] = []
    for kind, value in tree:
        found: set[str] | None = None
        if kind is kinds.LITERAL:
            found = {chr(value).lower()}
        elif kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value) and len(value) <= MOST:
            found = {chr(v).lower() for _, v in value}
        elif kind is kinds.SUBPATTERN:
            out += parts(value[3])
            continue
        elif kind is kinds.BRANCH:
            each = [joined(parts(branch)) for branch in value[1]]
            found = set().union(*each) if all(e is not None for e in each) else None
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, inner = value
            one = joined(parts(inner))
            if least:
                out += parts(inner) * min(int(least), MOST)
            if most == 1 and one is not None:
                found = {""} | one
            elif most == least and least <= MOST:
                continue
        out.append(found)
    return out


def joined(some: list[set[str] | None]) -> set[str] | None:
    """The strings of a whole concatenation, None if they are not few."""
    out = {""}
    for one in some:
        if one is None or len(out) * len(one) > MOST * MOST:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def mandatory(regex: str) -> list[list[str]]:
    """Clauses, each a list of lower-cased literals of three characters or more, one of which stands in every match of regex."""
    clauses, run = [], [""]
    for one in [*parts(_parser.parse(regex)), None]:
        if one is not None and len(run) * len(one) <= MOST * MOST:
            run = sorted({a + b for a, b in product(run, one)})
            continue
        clauses.append(run)
        run = sorted(one) if one is not None else [""]
    least = [[w for w in c if not any(v != w and v in w for v in c)] for c in clauses]  # a literal within another says the same
    return [c for c in least if all(len(w) > 2 for w in c)]


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # syntax that Java and Python share
    group: int  # the group whose length is checked
    least: int  # characters that it must have

    def query(self) -> list[list[list[str]]]:
        """The Boolean trigram query: every clause needs one literal, a literal all its trigrams; empty: no document can be ruled out."""
        return [[sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in clause] for clause in mandatory(self.regex)]

    def trigrams(self) -> set[str]:
        return {t for clause in self.query() for literal in clause for t in literal}


# The secret kinds, their patterns and lengths, in the order in which equal starts are listed.
BASE = [
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
EXTRA = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 30),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
]
RULES = BASE + EXTRA
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def index(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name; docs has columns key and text."""
    named = sorted(set().union(*(r.trigrams() for r in rules)))
    low = docs.select("key", F.lower("text").alias("low"))
    return low.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in named]))).alias("trigram"))


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (key, <kind> boolean ...): the postings' intersection for each rule that has a query."""
    ruled = [r for r in rules if r.query()]
    named = sorted(set().union(*(r.trigrams() for r in ruled)))
    has = {t: F.max(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(named)}
    at = {t: F.col(f"t{i}") for i, t in enumerate(named)}

    def holds(rule: Rule) -> Column:
        met = F.lit(True)
        for clause in rule.query():
            some = F.lit(False)
            for literal in clause:
                every = F.lit(True)
                for t in literal:
                    every = every & at[t]
                some = some | every
            met = met & some
        return met

    met = postings.groupBy("key").agg(*has.values()).select("key", *[holds(r).alias(r.kind) for r in ruled])
    return met.where(" OR ".join(f"`{r.kind}`" for r in ruled))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op, an associative one, over each beginning of an array of whole numbers: in blocks, then over the blocks' last ones."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    grown = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), x)).otherwise(x)))
    empty = F.array().cast("array<int>")

    def whole(within: Column) -> Column:
        ends = F.aggregate(F.transform(within, lambda w: F.try_element_at(w, F.lit(-1))), empty, grown)
        return bound(ends, lambda e: F.flatten(F.transform(within, lambda w, b: F.when(b == 0, w).otherwise(F.transform(w, lambda x: op(e[F.greatest(b - 1, F.lit(0))], x))))))

    return bound(F.transform(blocks, lambda block: F.aggregate(block, empty, grown)), whole)


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, end, kind) for one rule; the expression never matches the empty string."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    checked = sizes(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found)
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else 99
    lengths = F.flatten(F.zip_with(sizes(F.split(text, rule.regex, -1)), sizes(found), lambda g, m: F.array(F.coalesce(g, F.lit(0)), F.coalesce(m, F.lit(0)))))

    def spans(at: Column) -> Column:
        return F.transform(checked, lambda n, i: F.struct(at[2 * i].alias("start"), F.lit(rank).alias("rank"), at[2 * i + 1].alias("end"), F.lit(rule.kind).alias("kind"), n.alias("n")))

    fit = F.filter(bound(bound(lengths, lambda x: running(x, lambda a, b: a + b)), spans), lambda z: z["n"] >= rule.least)
    plain = F.transform(fit, lambda z: F.struct(z["start"].alias("start"), z["rank"].alias("rank"), z["end"].alias("end"), z["kind"].alias("kind")))
    return F.when(text.rlike(rule.regex), plain).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, text_col, spans array of (start, rank, end, kind) in order), one for each row of docs."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    keyed = rows.select("*", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"))
    met = candidates(stored(index(keyed.select("key", F.col(text_col).alias("text")), rules)), rules).withColumnRenamed("key", "met_key")
    join = keyed.join(met, F.col("key").eqNullSafe(F.col("met_key")), "left")
    empty = F.array().cast(SPANS)
    each = [F.when(F.coalesce(F.col(r.kind), F.lit(False)), matches(F.col(text_col), r)).otherwise(empty) if r.query() else matches(F.col(text_col), r) for r in rules]
    return join.select(id_col, text_col, F.sort_array(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with the union of its spans replaced by mark, one for each maximal run of overlapping spans."""
    def cut(end: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(end[F.greatest(i - 1, F.lit(0))])
        piece = lambda s, i: F.when(s["start"] < before(i), F.lit("")).otherwise(F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), F.lit(mark)))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(text, F.element_at(end, -1) + 1, F.length(text)))

    ends = bound(F.transform(spans, lambda s: s["end"]), lambda x: running(x, lambda a, b: F.greatest(a, b)))
    return F.when(F.size(spans) > 0, bound(ends, cut)).otherwise(text)
