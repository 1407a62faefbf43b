"""Secret scanning with a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: trigrams that any match must contain, joined
by "and" and "or". One pass over the corpus writes postings (trigram, document) for the trigrams that the rules name;
intersecting postings gives the candidate documents of each rule, and only those are searched with its expression.
Rules without mandatory trigrams search every document.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; null and repeated
ids change nothing; empty tables give empty results; offsets are code points, ends exclusive; texts are searched whole
however long; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, map_in_slices, saved, split_by_keys

#: Alternatives kept as exact strings while a query is derived, and members of a class that are spelled out.
EXACT, SPELLED = 64, 6


@dataclass(frozen=True)
class Rule:
    """``least`` is the shortest length that counts of ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("git_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("api_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def _all(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """The query that a text holding one of ``strings`` meets: a set of clauses, each a set of trigrams; None: any text."""
    if any(len(s) < 3 for s in strings):
        return None
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _least(clauses) -> frozenset[frozenset[str]]:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    return _least({x | y for x in a for y in b}) if len(a) * len(b) <= EXACT else min(a, b, key=len)


def _or(a, b):
    return None if a is None or b is None else _least(a | b)


def _node(op, arg) -> tuple[set[str] | None, object]:
    """Of one part of an expression: the strings it can match, if few, and else the query that its matches meet."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None, None
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 2 * SPELLED and x[1] < 128:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= SPELLED and all(c.isascii() for c in chars) else (None, None)
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}, None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.ATOMIC_GROUP:
        return _sequence(arg)
    if op is C.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found):
            return set().union(*(e for e, _ in found)), None
        query = frozenset()
        for exact, q in found:
            query = _or(query, q if exact is None else _all(exact))
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, sub = arg
        exact, query = _sequence(sub)
        if exact is not None and most <= 4 and len(exact) ** max(1, most) <= EXACT:
            return {"".join(x) for n in range(least, most + 1) for x in product(exact, repeat=n)}, None
        if least == 0:
            return None, None
        return None, query if exact is None else _all({s * min(least, 4) for s in exact} if len(exact) == 1 else exact)
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    exact, query, whole = {""}, None, True
    for op, arg in nodes:
        e, q = _node(op, arg)
        if e is not None and len(e) * len(exact) <= EXACT:
            exact = {a + b for a in exact for b in e}
            continue
        whole = False
        query = _and(query, _all(exact))
        exact = e if e is not None and len(e) <= EXACT else {""}
        query = _and(query, q)
    return (exact, None) if whole else (None, _and(query, _all(exact)))


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match contains in full; None if none are mandatory."""
    exact, query = _sequence(P.parse(pattern, re.ASCII))
    return _all(exact) if exact is not None else query


def folded(text: str) -> str:
    """A-Z lower-cased, and nothing else: the index is blind to case, the search is not."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def postings(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """The inverted index over ``trigrams`` of whole texts: trigram, doc; ``docs`` has doc (a number) and text."""
    wanted = sorted(trigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owners = [], []
            for i, text in enumerate(b.column(1)):
                if text.is_valid:
                    low = folded(text.as_py())
                    here = [t for t in wanted if t in low]
                    found += here
                    owners += [i] * len(here)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), b.column(0).take(pa.array(owners, pa.int64()))], names=["trigram", "doc"])

    return map_in_slices(docs.select("doc", "text"), run, "trigram string, doc long")


def candidates(index: DataFrame, queries: dict[int, frozenset[frozenset[str]]]) -> DataFrame:
    """doc, rules: the numbers of the rules one of whose clauses has all its trigrams posted for the document."""
    rows = [(r, k, len(clause), t) for r, q in sorted(queries.items()) for k, clause in enumerate(sorted(map(sorted, q))) for t in clause]
    # as many rows as the rules have trigrams, whatever the corpus
    clauses = index.sparkSession.createDataFrame(rows, "rule int, clause int, needs int, trigram string")
    hits = index.join(F.broadcast(clauses), "trigram").groupBy("doc", "rule", "clause", "needs").agg(F.count_distinct("trigram").alias("has"))
    return hits.filter("has = needs").groupBy("doc").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _with_rules(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """All columns of ``docs``, and last the numbers of the rules with mandatory trigrams that are to be searched for.

    The index knows a document by a hash of its id and text: documents that share one also share candidates, which the
    exact search makes harmless, and rows without an id are not one document.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    found, doc = free_name("_rules", docs), free_name("_doc", docs)
    if not queries:
        return docs.withColumn(found, F.array().cast("array<int>"))
    number = F.xxhash64("doc_id", "text")
    with Scratch(docs.sparkSession, "secrets") as kept:
        index = kept.save(postings(docs.select(number.alias("doc"), "text"), {t for q in queries.values() for c in q for t in c}), "trigrams")
        narrowed = saved(candidates(index, queries).toDF(doc, found), "secret-candidates")
    maybe, others = split_by_keys(docs, number, narrowed.select(doc))
    marked = maybe.withColumn(doc, number).join(narrowed, doc, "left").drop(doc)
    return marked.unionByName(others.withColumn(found, F.lit(None).cast("array<int>")))


class Search:
    """Finds the spans of a text: of rules that have no mandatory trigrams, and of those that the index proposes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.always = [i for i, r in enumerate(rules) if trigram_query(r.pattern) is None]

    def spans(self, text: str | None, proposed: list[int] | None) -> list[tuple[int, int, int]]:
        """start, number of the rule, end; sorted."""
        out = []
        for i in sorted({*self.always, *(proposed or ())}) if text else ():
            rule = self.rules[i]
            for m in self.compiled[i].finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((m.start(), i, m.end()))
        return sorted(out)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, spans: array of kind, start, end in order of start, then of the rules."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(rules)
        for b in batches:
            found = [search.spans(text.as_py(), proposed.as_py()) for text, proposed in zip(b.column(1), b.column(2))]
            out = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, span)], names=["doc_id", "text", "spans"])

    return map_in_slices(_with_rules(docs, rules), run, f"doc_id {kind}, text string, spans array<struct<kind: string, start: bigint, end: bigint>>")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret, or run of overlapping ones, replaced by ``<secret:kind>``; all columns stay. n_chars,
    if there is one, becomes the new length of a text that changed."""
    names = docs.columns
    t, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(rules)
        for b in batches:
            columns = list(b.columns[: len(names)])
            texts = columns[t].to_pylist()
            sizes = columns[n].to_pylist() if n is not None else None
            for i, proposed in enumerate(b.column(len(names)).to_pylist()):
                spans = search.spans(texts[i], proposed)
                if spans:
                    texts[i] = cut_out(texts[i], spans, rules)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns[t] = pa.array(texts, columns[t].type)
            if sizes:
                columns[n] = pa.array(sizes, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_in_slices(_with_rules(docs, rules), run, docs.schema)


def cut_out(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """``text`` with its spans replaced; of those that begin together the longest counts."""
    out, done = [], 0
    for start, i, end in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if start >= done:
            out += [text[done:start], f"<secret:{rules[i].kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
