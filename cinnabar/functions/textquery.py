"""Text search: token columns, the classic query syntax as a column, and TF-IDF relevance.

A query is parsed to a tree of clauses. The tree as a column tells which rows are hits; its leaves, each with its field and
boost, give the relevance: words and phrases by how often they occur in the field, everything that stands for many words
(wildcards, fuzzy words, ranges, all rows) by its boost alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: words that are not indexed (fixed value)
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
LONGEST = 255
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column, stop: bool = True) -> Column:
    """Lower-case words in order, with repeats; pieces of at most 255 characters. Null for null."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda x: (x != "") & (F.length(x) <= LONGEST))
    return F.filter(words, lambda x: ~x.isin(STOP_WORDS)) if stop else words


@dataclass
class Leaf:
    """One thing to look for in a field. ``words``: next to each other, or with ``slop`` words between them; none: it counts the same wherever it is."""

    field: str
    hit: Column
    words: list[str] = field(default_factory=list)
    slop: int = 0
    boost: float = 1.0


@dataclass
class Clause:
    must: bool
    banned: bool
    node: Leaf | Group | None


@dataclass
class Group:
    clauses: list[Clause]

    @property
    def hit(self) -> Column:
        musts = [c.node.hit for c in self.clauses if c.must]
        maybe = [c.node.hit for c in self.clauses if not c.must and not c.banned]
        out = None
        for m in musts:
            out = m if out is None else out & m
        if not musts:
            for m in maybe:
                out = m if out is None else out | m
        out = F.lit(False) if out is None else out
        for c in self.clauses:
            if c.banned:
                out = out & ~F.coalesce(c.node.hit, F.lit(False))
        return out

    def leaves(self) -> list[Leaf]:
        """What a hit is scored by."""
        return [x for c in self.clauses if not c.banned for x in ([c.node] if isinstance(c.node, Leaf) else c.node.leaves())]

    def boosted(self, by: float) -> None:
        for x in self.leaves():
            x.boost *= by


_LEX = re.compile(r'\s*(?:(?P<op>&&|\|\||[()!+\-])|(?P<field>[\w.]+):(?=\S)|"(?P<phrase>(?:\\.|[^"\\])*)"|(?P<range>[\[{][^\]}]*\s+TO\s+[^\]}]*[\]}])|(?P<slop>~[0-9.]*)|(?P<word>(?:\\.|[^\s()"\\:^])+)|(?P<boost>\^[0-9.]+))')


class BadQuery(ValueError):
    pass


class Parser:
    """``a b`` (or), ``+a -b``, AND OR NOT, ``field:x``, ``"a phrase"``, ``"a phrase"~2``, ``pre*``, ``w?ld``, ``fuzz~``, ``[a TO b]``, ``x^2``, ``*:*``, parentheses.

    ``fields`` gives each field's token array; a keyword field is an array of its one value.
    """

    def __init__(self, fields: dict[str, Column], default: str = "text", keyword: frozenset[str] = frozenset({"_id", "_fields", "_codebook"})):
        self.fields, self.default, self.keyword = fields, default, keyword

    def __call__(self, text: str) -> Column:
        return F.coalesce(self.tree(text).hit, F.lit(False))

    def tree(self, text: str) -> Group:
        self.lexed = []
        at = 0
        text = text.strip().replace("*:*", "__all__")
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise BadQuery(f"can't read {text[at:]!r}")
            self.lexed.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0
        out = self._clauses(self.default)
        if self.at < len(self.lexed):
            raise BadQuery("a parenthesis closes nothing")
        return out

    def _peek(self):
        return self.lexed[self.at] if self.at < len(self.lexed) else (None, None)

    def _clauses(self, field: str) -> Group:
        parts: list[Clause] = []
        join = None
        while True:
            kind, v = self._peek()
            if kind is None or (kind, v) == ("op", ")"):
                break
            self.at += 1
            if (kind, v) in (("word", "AND"), ("op", "&&")):
                join = "and"
                continue
            if (kind, v) in (("word", "OR"), ("op", "||")):
                join = "or"
                continue
            must = banned = False
            while (kind, v) in (("op", "+"), ("op", "-"), ("op", "!"), ("word", "NOT")):
                must, banned = v == "+", v != "+"
                kind, v = self._peek()
                self.at += 1
            if join == "and":
                must = must or not banned
                if parts and not parts[-1].banned:
                    parts[-1].must = True
            join = None
            node = self._one(kind, v, field)
            if self._peek()[0] == "boost":
                by = float(self._peek()[1][1:])
                self.at += 1
                if isinstance(node, Group):
                    node.boosted(by)
                elif node is not None:
                    node.boost *= by
            parts.append(Clause(must, banned, node))
        return Group([p for p in parts if p.node is not None])

    def _one(self, kind, v, field: str) -> Leaf | Group | None:
        if kind == "field":
            k, w = self._peek()
            self.at += 1
            return self._one(k, w, v)
        if (kind, v) == ("op", "("):
            out = self._clauses(field)
            if self._peek() != ("op", ")"):
                raise BadQuery("a parenthesis stays open")
            self.at += 1
            return out
        if kind is None or kind in ("op", "slop", "boost"):
            raise BadQuery("something is missing")
        if v == "__all__":
            return Leaf(field, F.lit(True))
        if field not in self.fields:
            return Leaf(field, F.lit(False))
        array = F.coalesce(self.fields[field], F.array().cast("array<string>"))
        if kind == "range":
            lo, hi = re.split(r"\s+TO\s+", v[1:-1].strip())
            lo, hi = (x.strip().strip('"').lower() for x in (lo, hi))
            inc_lo, inc_hi = v[0] == "[", v[-1] == "]"
            return Leaf(field, F.exists(array, lambda x: (F.lit(True) if lo == "*" else x >= lo if inc_lo else x > lo) & (F.lit(True) if hi == "*" else x <= hi if inc_hi else x < hi)))
        v = re.sub(r"\\(.)", r"\1", v)
        slop = 0
        if kind == "phrase" and self._peek()[0] == "slop":
            slop = int(float(self._peek()[1][1:] or 0))
            self.at += 1
        if field in self.keyword:
            return Leaf(field, F.array_contains(array, v), [v]) if "*" not in v and "?" not in v else Leaf(field, self._wild(array, v))
        if kind == "phrase":
            return self._words(field, array, v, slop)
        if m := re.fullmatch(r"(.+)~([0-9.]*)", v):
            most = int(float(m[2])) if m[2] and float(m[2]) >= 1 else 2
            return Leaf(field, F.exists(array, lambda x: F.levenshtein(x, F.lit(m[1].lower())) <= most))
        if "*" in v or "?" in v:
            return Leaf(field, self._wild(array, v.lower()))
        return self._words(field, array, v, 0)

    @staticmethod
    def _wild(array: Column, v: str) -> Column:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in v) + "$"
        return F.exists(array, lambda x: x.rlike(pattern))

    @staticmethod
    def _words(field: str, array: Column, text: str, slop: int) -> Leaf | None:
        """One word, or several next to each other."""
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in STOP_WORDS]
        if not words:
            return None
        if len(words) == 1:
            return Leaf(field, F.array_contains(array, words[0]), words)
        if slop:
            return Leaf(field, F.array_contains(array, words[0]) & (occurrences(array, words, slop) > 0), words, slop)
        # the words joined with a mark no word holds
        joined = F.concat(F.lit(" "), F.array_join(array, " "), F.lit(" "))
        return Leaf(field, F.array_contains(array, words[0]) & joined.contains(" " + " ".join(words) + " "), words)


def occurrences(array: Column, words: list[str], slop: int = 0) -> Column:
    """How often the words stand next to each other in this order, with up to ``slop`` words between them; in another order, two less."""
    if len(words) == 1:
        return F.size(F.filter(array, lambda x: x == words[0]))
    # the array is made once, not anew for every place in it
    return F.element_at(F.transform(F.array(array), lambda a: _places(a, words, slop)), 1)


def _places(array: Column, words: list[str], slop: int) -> Column:
    n = len(words)
    places = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)))
    # the words of a window joined with a mark no word holds
    window = lambda i, size: F.concat(F.lit(" "), F.array_join(F.slice(array, i, size), " "), F.lit(" "))
    if not slop:
        return F.size(F.filter(places, lambda i: window(i, n) == " " + " ".join(words) + " "))
    ordered = "^ " + r" (?:\S+ )*?".join(map(re.escape, words)) + " "
    hit = lambda i: window(i, n + slop).rlike(ordered)
    if slop < 2:
        return F.size(F.filter(places, hit))

    def any_order(i: Column) -> Column:
        some = F.slice(array, i, n + slop - 2)
        out = F.get(some, F.lit(0)).isin(words)
        for w in set(words):
            out = out & (F.size(F.filter(some, lambda x: x == w)) >= words.count(w))
        return out

    return F.size(F.filter(places, lambda i: hit(i) | F.coalesce(any_order(i), F.lit(False))))


def scored(df: DataFrame, array: Column, words: list[str], key: str) -> DataFrame:
    """(key, score) of the rows with any of ``words``: sqrt(tf) idf^2 over the root of the row's length, coordinated."""
    return relevance(df, [Leaf("text", F.array_contains(array, w), [w]) for w in sorted({w.lower() for w in words})], {"text": array}, key)


def relevance(df: DataFrame, leaves: list[Leaf], fields: dict[str, Column], key: str) -> DataFrame:
    """(key, score) of the rows that any leaf finds.

    A leaf of words gives sqrt(tf) idf^2 boost over the root of its field's length, idf being 1 + ln(rows with the field /
    (rows with the leaf + 1)); any other leaf its boost. The sum is multiplied by the part of the leaves that are found.
    One pass counts, one scores; both aggregate on the map side.
    """
    names = sorted({x.field for x in leaves if x.words and x.field in fields})
    own = df.select(F.col(key), *[F.coalesce(fields[f], F.array().cast("array<string>")).alias(f"f{i}") for i, f in enumerate(names)], *[F.coalesce(x.hit, F.lit(False)).alias(f"h{i}") for i, x in enumerate(leaves)])
    count = [occurrences(F.col(f"f{names.index(x.field)}"), x.words, x.slop) if x.words and x.field in fields else F.col(f"h{i}").cast("int") for i, x in enumerate(leaves)]
    # one tokenization: a narrow table of counts serves both the statistics and the scores
    own = cut(own.select(key, *[F.size(f"f{i}").alias(f"n{i}") for i in range(len(names))], *[c.alias(f"w{i}") for i, c in enumerate(count)]))
    seen = own.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"n{i}") for i in range(len(names))], *[F.count_if(F.col(f"w{i}") > 0).alias(f"d{i}") for i in range(len(leaves))]).first()
    parts = []
    for i, x in enumerate(leaves):
        if x.words and x.field in fields:
            f = names.index(x.field)
            idf = 1 + log(max(seen[f"n{f}"], 1) / (seen[f"d{i}"] + 1))
            parts.append(f"case when n{f} > 0 then sqrt(w{i}) * cast('{idf**2 * x.boost!r}' as double) / sqrt(n{f}) else 0D end")
        else:
            parts.append(f"w{i} * cast('{x.boost!r}' as double)")
    hit = " + ".join(f"cast(w{i} > 0 as int)" for i in range(len(leaves))) or "0"
    return own.where(f"({hit}) > 0").select(key, F.expr(f"({' + '.join(parts) or '0D'}) * ({hit}) / {max(len(leaves), 1)}").alias("score"))
