"""Queries: parsing, boolean evaluation over postings, relaxation.

A query becomes flags: one aggregate over the postings of its terms tells for
each document which terms it has, and the boolean tree is a filter on them. So
any tree costs one scan of the few terms' postings and one shuffle of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CANDIDATES = 10_000


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


@dataclass
class ParsedQuery:
    must: list[str] = field(default_factory=list)
    phrases: list[tuple[str, ...]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    or_groups: list[list[str]] = field(default_factory=list)
    site: str | None = None

    def terms(self) -> dict[str, int]:
        """Query term frequencies; excluded terms don't count."""
        out: dict[str, int] = {}
        for t in [*self.must, *(t for p in self.phrases for t in p), *(t for g in self.or_groups for t in g)]:
            out[t] = out.get(t, 0) + 1
        return out


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFC", text).lower()).split()


def parse(raw: str, tokenize: Callable[[str], list[str]] = words_of) -> ParsedQuery:
    """Quoted phrases, -excluded, site:host, and OR (upper case) between words; the rest must occur.

    OR joins the last wanted word with the next, and with more that OR follows; where either is missing it is a word like others.
    Words outside quotes are tokenized together, so that compounds are found across them.
    """
    out = ParsedQuery()
    outside = []
    for k, piece in enumerate(re.split(r'"([^"]*)"', raw or "")):
        if k % 2 == 0:
            outside.append(piece)
        elif words := tokenize(piece):
            out.phrases.append(tuple(words))
    words = "".join(outside).split()
    wanted: list[str] = []
    excluded: list[str] = []
    groups: list[list[str]] = []
    at = 0
    while at < len(words):
        word = words[at]
        at += 1
        if word.lower().startswith("site:"):
            out.site = word[len("site:") :].lower() or out.site
        elif word == "OR" and wanted and at < len(words):
            group = [wanted.pop(), words[at]]
            while at + 2 < len(words) and words[at + 1] == "OR":
                at += 2
                group.append(words[at])
            at += 1
            if at < len(words) and words[at] == "OR" and at + 1 == len(words):
                at += 1  # nothing follows the last one
            groups.append(group)
        elif word[0] != "-":
            wanted.append(word)
        elif len(word) > 1:
            excluded.append(word[1:])
    out.must, out.excluded = tokenize(" ".join(wanted)), tokenize(" ".join(excluded))
    for group in groups:
        terms = [t for word in group for t in tokenize(word)]
        if len(terms) == 1:
            out.must.append(terms[0])
        elif terms:
            out.or_groups.append(terms)
    return out


def to_ast(q: ParsedQuery):
    parts = [*(Term(t) for t in q.must), *(Phrase(p) for p in q.phrases), *(Or(tuple(Term(t) for t in g)) for g in q.or_groups)]
    return And((*parts, *(Not(Term(t)) for t in q.excluded)))


def leaves(node) -> set[str]:
    if isinstance(node, Term):
        return {node.term}
    if isinstance(node, Phrase):
        return set(node.terms)
    if isinstance(node, Not):
        return leaves(node.child)
    return set().union(*(leaves(c) for c in node.children)) if node.children else set()


def check(node, under_and: bool = False) -> None:
    """NOT stands only under AND, beside something positive."""
    if isinstance(node, Not):
        if not under_and:
            raise ValueError("NOT stands only under AND")
        check(node.child)
    elif isinstance(node, And):
        if node.children and all(isinstance(c, Not) for c in node.children):
            raise ValueError("AND needs something that isn't negated")
        for c in node.children:
            check(c, True)
    elif isinstance(node, Or):
        for c in node.children:
            check(c)


def estimated(node, df: dict[str, int], n_docs: int) -> int:
    """At most how many documents a tree matches, from its terms' document frequencies."""
    if isinstance(node, Term):
        return df.get(node.term, 0)
    if isinstance(node, Phrase):
        return min((df.get(t, 0) for t in node.terms), default=0)
    if isinstance(node, Not):
        return n_docs
    if isinstance(node, Or):
        return min(sum(estimated(c, df, n_docs) for c in node.children), 2**31 - 1)
    return min((estimated(c, df, n_docs) for c in node.children if not isinstance(c, Not)), default=0)


def phrase_match(positions: list[Column]) -> Column:
    """Some place of the first word is followed by the others in order."""
    first, *others = positions
    if not others:
        return F.coalesce(F.size(first) > 0, F.lit(False))
    found = F.exists(first, lambda p: reduce(lambda a, b: a & b, (F.array_contains(o, (p + F.lit(k + 1)).cast("int")) for k, o in enumerate(others))))
    return F.coalesce(found, F.lit(False))


def condition(node, column: dict[str, Column]) -> Column:
    if isinstance(node, Term):
        return column[node.term].isNotNull()
    if isinstance(node, Phrase):
        return phrase_match([column[t] for t in node.terms]) if node.terms else F.lit(True)
    if isinstance(node, Not):
        return ~condition(node.child, column)
    parts = [condition(c, column) for c in node.children]
    if not parts:
        return F.lit(False)
    return reduce(lambda a, b: a & b, parts) if isinstance(node, And) else reduce(lambda a, b: a | b, parts)


def matrix(posts: DataFrame, terms: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """One row for each document with any of the terms; a column of positions for each term, null if it lacks it."""
    rows = posts.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{k}") for k, t in enumerate(terms)))
    return rows, {t: F.col(f"_p{k}") for k, t in enumerate(terms)}


def evaluate(posts: DataFrame, node) -> DataFrame:
    """(doc_id) of the documents that a tree matches."""
    check(node)
    terms = sorted(leaves(node))
    if not terms:
        return posts.select("doc_id").limit(0)
    rows, column = matrix(posts, terms)
    return rows.where(condition(node, column)).select("doc_id")


def resolve(posts: DataFrame, q: ParsedQuery, on_site: DataFrame | None = None, limit: int | None = None, df: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id) candidates, all or the `limit` with the lowest ids, and the terms dropped to have any.

    Unknown terms go first, then the term that most documents have, and so on,
    while more than one is left. Phrases, groups, exclusions and the site stay.
    All steps are tried in one plan: a document's level is how many terms must
    be dropped before it matches, and the lowest level that has documents wins.
    """
    every = sorted({*q.terms(), *q.excluded})
    if not every:
        return posts.select("doc_id").limit(0), []
    counted = posts.where(F.col("term").isin(*q.must or [""])).groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df is None else df.where(F.col("term").isin(*q.must or [""]))
    known = {r["term"]: r["df"] for r in counted.collect()}  # one row a query term
    musts = list(dict.fromkeys(q.must))
    fixed = [n for n in to_ast(ParsedQuery([], q.phrases, q.excluded, q.or_groups)).children]
    unknown = [t for t in musts if t not in known]
    rest = sorted((t for t in musts if t in known), key=lambda t: (-known[t], musts.index(t)))
    order = unknown + rest
    least = 0 if any(not isinstance(n, Not) for n in fixed) else 1
    rows, column = matrix(posts, every)
    keep = reduce(lambda a, b: a & b, (condition(n, column) for n in fixed), F.lit(True))
    rows = rows.where(keep)
    if on_site is not None:
        rows = rows.join(on_site.select("doc_id"), "doc_id", "left_semi")
    level = F.lit(None).cast("int")
    for dropped in range(max(len(order) - least, 0), -1, -1):
        needed = order[dropped:]
        has = reduce(lambda a, b: a & b, (column[t].isNotNull() for t in needed), F.lit(True))
        level = F.when(has, F.lit(dropped)).otherwise(level)
    # the fewest dropped terms for which a document matches
    rows = rows.select("doc_id", level.alias("_level")).where("_level IS NOT NULL")
    best = rows.agg(F.min("_level").alias("n")).first()["n"]
    if best is None:
        return rows.select("doc_id").limit(0), []
    found = rows.where(F.col("_level") <= best).select("doc_id")
    return found if limit is None else found.orderBy("doc_id").limit(limit), order[:best]
