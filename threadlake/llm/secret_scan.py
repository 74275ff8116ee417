"""Secret scans over a trigram inverted index.

From each rule's regular expression follows a Boolean query of trigrams: an OR of
clauses, each an AND of trigrams that any match must hold.  The index lists,
for each trigram some query asks for, the documents it stands in; a clause's
documents are the intersection of its postings.  Only they run the rule's
expression, on their whole text.  A rule with no mandatory trigram runs on all documents.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import save, stage

#: Beyond so many spellings a part of an expression counts as a gap, which only weakens its query.
MOST_SPELLINGS = 64
#: A clause keeps so many of its trigrams, those with the fewest letters first, as prose holds them least; fewer only weaken it.
MOST_GRAMS = 6


class Rule(NamedTuple):
    """``group`` must have ``least`` characters or more, else the match is dropped (its text is spent all the same)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The rules of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = (*BASE, *MORE)

GAP = None


def _spellings(tree) -> list[tuple]:
    """Ways to write what the tree matches: tuples of characters with ``GAP`` where anything may stand."""
    out: list[tuple] = [()]
    for op, arg in tree:
        part: list[tuple] = [(GAP,)]
        if op is sre.LITERAL:
            part = [(chr(arg).lower(),)]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = [(chr(a).lower(),) for _, a in arg]
        elif op is sre.BRANCH:
            part = [s for branch in arg[1] for s in _spellings(branch)]
        elif op is sre.SUBPATTERN:
            part = _spellings(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            once = _spellings(body)
            if (low, high) == (0, 1):
                part = [(), *once]
            elif low:
                part = [(*s, GAP) for s in once]
        elif op is sre.AT:
            part = [()]
        if len(part) * len(out) > MOST_SPELLINGS:
            part = [(GAP,)]
        out = list(dict.fromkeys((*a, *b) for a in out for b in part))
    return out


def _trigrams(spelling: tuple) -> frozenset[str]:
    return frozenset("".join(w) for k in range(len(spelling) - 2) if GAP not in (w := spelling[k : k + 3]))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams; a text that matches holds all of one clause, case aside.  Empty: nothing is mandatory."""
    clauses = {_trigrams(s) for s in _spellings(sre_parser.parse(regex))}
    if frozenset() in clauses:
        return []
    # A clause that asks for more than another adds nothing.
    least = [c for c in clauses if not any(d < c for d in clauses)]
    short = {frozenset(sorted(c, key=lambda g: (sum(x.isalpha() for x in g), g))[:MOST_GRAMS]) for c in least}
    return sorted((c for c in short if not any(d < c for d in short)), key=sorted)


def postings(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index ``(gram, rid)`` of staged documents, stored in order of the trigram (its place in ``vocabulary``)."""
    # Lower-casing all letters can only add trigrams, never hide one of an ASCII match.
    low = docs.select("rid", F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary)]))
    return save(low.select("rid", F.explode(held).alias("gram")).repartitionByRange("gram", "rid").sortWithinPartitions("gram", "rid"), "postings")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]], vocabulary: list[str]) -> DataFrame:
    """``(rid, rules)``: the rules whose query a document's trigrams satisfy, by intersecting postings."""
    code = {g: i for i, g in enumerate(vocabulary)}
    clauses = [(rule, c, len(clause), code[g]) for rule, of in queries.items() for c, clause in enumerate(of) for g in clause]
    wanted = index.sparkSession.createDataFrame(clauses, "rule int, clause int, size int, gram int")
    met = index.join(F.broadcast(wanted), "gram")  # a few rows a rule
    whole = met.groupBy("rid", "rule", "clause", "size").agg(F.count("*").alias("n")).where("n = size")
    return save(whole.groupBy("rid").agg(F.collect_set("rule").alias("rules")), "candidates")


def _spans(text: Column, k: int, rule: Rule) -> Column:
    """``array<struct<start,kind,end>>`` of a rule's leftmost non-overlapping matches, in code points.

    Pieces between the matches and the matches themselves take turns, so places are sums of lengths.
    """
    between = F.split(text, rule.regex, -1)
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    rows = F.arrays_zip(F.transform(between, lambda p: F.length(p)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"), F.transform(held, lambda g: F.length(g)).alias("held"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, r):
        start = acc["at"] + r["gap"]
        end = start + F.coalesce(r["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        # The last piece has no match behind it.
        return F.struct(end.alias("at"), F.when(F.coalesce(r["held"], F.lit(-1)) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.regexp_like(text, F.lit(rule.regex)), F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]).otherwise(none)


def _tight(rule: Rule) -> Rule:
    """The same matches without the ones that would be dropped, for a rule that is one class repeated: most texts then match nowhere."""
    tree = list(sre_parser.parse(rule.regex))
    lone = len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and tree[0][1][:2] == (1, sre.MAXREPEAT) and tree[0][1][2][0][0] is sre.IN
    return rule._replace(regex=rule.regex.removesuffix("+") + f"{{{rule.least},}}") if lone and rule.group == 0 else rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``spans``, an array of ``(start, kind, end)`` in order; ``kind`` is the rule's place in ``rules``.

    Whole texts are scanned.  A null text counts as empty and has no spans; an empty table gives an empty result;
    repeated rows and null or repeated ids are scanned each on its own; other columns are not read.  Rules match on their own: spans of
    different kinds may overlap, those of one kind never do.  Equal starts are in the order of the rules.
    """
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex))}
    vocabulary = sorted({g for of in queries.values() for clause in of for g in clause})
    base = stage(docs, "scanned", id=F.col(f"`{id_col}`"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    if queries:
        base = base.join(candidates(postings(base, vocabulary), queries, vocabulary), "rid", "left")
    else:
        base = base.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [F.when(F.array_contains("rules", k), _spans(F.col("text"), k, r)).otherwise(none) if k in queries else _spans(F.col("text"), k, _tight(r)) for k, r in enumerate(rules)]
    found = base.select("id", *[p.alias(f"s{k}") for k, p in enumerate(parts)])
    return found.select("id", F.array_sort(F.concat(none, *[f"s{k}" for k in range(len(rules))])).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the first ``base`` rules' matches (``n_<kind>``), the digest of their spans, and all spans as text.

    A document without matches has counts of zero, the digest of the empty string and empty ``spans``; see :func:`scan` for nulls, repeats and empty tables.
    """
    found = scan(docs, rules, id_col, text_col)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    own = F.filter("spans", lambda s: s["kind"] < base)
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in range(base)], F.sha2(F.encode(joined(own, rules), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))
