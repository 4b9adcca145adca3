"""Full-text search with positions: analysis to terms, postings of a query's terms, query strings, scores.

A query string has words, "phrases in quotes", prefix* and the operators AND, OR, NOT (also + - before a word, and
parentheses). AND binds closer than OR, words side by side are joined by OR. What stands behind NOT only
excludes; a query that only excludes finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespan.functions.stem import porter, stems
from talespan.operators.archive import BM25_B, BM25_K1
from talespan.runtime import keep

#: Letters, digits and marks of any script; an apostrophe joins letters.
WORD = r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*"
# Fixed list: common English words that are not indexed.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: A stem and its word are the same but for so many last letters of the stem.
CHANGED = 2


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: english drops common words and possessive endings and stems the others."""

    english: bool = True

    def words(self, text: Column) -> Column:
        """Array of (pos, word) of a text, without common words, whose places stay counted."""
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
        if self.english:
            words = F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", ""))
        placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
        return F.filter(placed, lambda x: ~x["word"].isin(STOP_WORDS)) if self.english else placed

    def terms(self, text: str) -> list[tuple[int, str]]:
        """The same of a query's words, with their stems."""
        found = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text.lower())
        if not self.english:
            return list(enumerate(found))
        return [(i, porter(w)) for i, w in enumerate(re.sub("['’]s$", "", w) for w in found) if w not in STOP_WORDS]


@dataclass
class Query:
    """A parsed query: what must be found in places (leaves), and how to judge a document by which of them it has."""

    leaves: list[tuple[str, list[tuple[int, str]]]] = field(default_factory=list)
    #: Leaves that raise the score.
    wanted: set[int] = field(default_factory=set)
    test: Callable[[Callable[[int], Column]], Column] | None = None


def parse(text: str, analyzer: Analyzer) -> Query:
    """A query string as leaves and a test; unfinished syntax is read as far as it goes."""
    parts = re.findall(r'"[^"]*"?|[()]|[+-](?=\S)|[^\s()"]+', text)
    out, at = Query(), 0
    Test = Callable[[Callable[[int], Column]], Column]

    def peek() -> str:
        return parts[at] if at < len(parts) else ""

    def leaf(kind: str, terms: list[tuple[int, str]], negative: bool) -> Test | None:
        if not terms:
            return None  # only common words
        out.leaves.append((kind, terms))
        i = len(out.leaves) - 1
        if not negative:
            out.wanted.add(i)
        return lambda has: has(i)

    def atom(negative: bool) -> Test | None:
        nonlocal at
        part = peek()
        at += 1
        if part in ("NOT", "-"):
            test = atom(not negative)
            return None if test is None else lambda has: ~test(has)
        if part == "+":
            return atom(negative)
        if part == "(":
            test = either(negative)
            at += peek() == ")"
            return test
        if part.endswith("*") and len(part) > 1 and not part.startswith('"'):
            return leaf("prefix", [(0, part[:-1].lower())], negative)
        terms = analyzer.terms(part)
        return leaf("phrase", [(p - terms[0][0], t) for p, t in terms] if terms else [], negative)

    def both(negative: bool) -> Test | None:
        nonlocal at
        tests = [atom(negative)]
        while peek() == "AND":
            at += 1
            tests.append(atom(negative))
        known = [t for t in tests if t is not None]
        return None if not known else lambda has: _all([t(has) for t in known])

    def either(negative: bool) -> Test | None:
        nonlocal at
        yes, no = [], []
        while peek() and peek() != ")":
            if peek() == "OR":
                at += 1
                continue
            excludes = peek() in ("NOT", "-")
            test = both(negative)
            if test is not None:
                (no if excludes else yes).append(test)
        if not yes and not no:
            return None
        # alternatives side by side; what is excluded is excluded from all of them
        return lambda has: _all(([_any([t(has) for t in yes])] if yes else []) + [t(has) for t in no])

    tests = []
    while at < len(parts):
        test = either(False)
        at += peek() == ")"
        if test is not None:
            tests.append(test)
    out.test = (lambda has: _any([t(has) for t in tests])) if tests else None
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _head(term: str) -> str:
    return re.escape(term[: max(1, len(term) - CHANGED)])


def search(documents: DataFrame, text: str, key: str = "doc_id", column: str = "text", analyzer: Analyzer | None = None) -> DataFrame:
    """(key, score) of the documents that the query string finds, see `searches`."""
    return searches(documents, [text], key, column, analyzer).drop("query")


def searches(documents: DataFrame, texts: list[str], key: str = "doc_id", column: str = "text", analyzer: Analyzer | None = None) -> DataFrame:
    """(key, score, query) of the documents that each different query string finds; texts become words once for all of them.

    Only words that can be of the queries' terms become postings, before anything is shuffled; they are kept with the texts'
    lengths. A phrase is found where all its words stand in their places. Terms and phrases score by BM25 with the frequency
    of the whole phrase, a prefix scores 1. Null texts have no words; repeated keys are taken as one document. An empty query finds nothing.
    """
    analyzer = analyzer or Analyzer()
    spark = documents.sparkSession
    known = [(text, q) for text in dict.fromkeys(texts) for q in (parse(text, analyzer),) if q.test is not None and q.wanted]
    if not known:
        return documents.select(key, F.lit(0.0).alias("score"), F.lit("").alias("query")).limit(0)
    # leaves are numbered through all queries
    leaves = [(n, i, kind, terms) for n, (_, q) in enumerate(known) for i, (kind, terms) in enumerate(q.leaves)]
    place = {(n, i): leaf for leaf, (n, i, _, _) in enumerate(leaves)}
    sought = {(kind, t) for _, _, kind, terms in leaves for _, t in terms}
    if analyzer.english:
        near = "^(" + "|".join(sorted({_head(t) for _, t in sought})) + ")"
        fit = lambda w: w.rlike(near)
    else:
        whole = sorted(t for kind, t in sought if kind == "phrase")
        fit = lambda w: _any([*([w.isin(whole)] if whole else []), *(F.startswith(w, F.lit(t)) for kind, t in sorted(sought) if kind == "prefix")])
    rows = keep(documents.select(key, analyzer.words(F.col(column)).alias("words")).select(key, F.size("words").alias("len"), F.filter("words", lambda x: fit(x["word"])).alias("posts")))
    posts = rows.select(key, "len", F.inline("posts"))
    posts = posts.withColumn("term", stems("word") if analyzer.english else F.col("word"))
    elements = spark.createDataFrame([(n, leaf, kind, len(terms), offset, term) for leaf, (n, _, kind, terms) in enumerate(leaves) for offset, term in terms], "q int, leaf int, kind string, parts int, offset int, sought string")
    fits = ((F.col("kind") == "phrase") & (F.col("term") == F.col("sought"))) | ((F.col("kind") == "prefix") & F.startswith("term", F.col("sought")))
    met = posts.join(F.broadcast(elements), fits)  # as many rows as the queries have words
    places = met.groupBy(key, "q", "leaf", "parts", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("n"), F.max("len").alias("len")).where("n = parts")
    found = keep(places.groupBy(key, "q", "leaf").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len")))
    df = found.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    weighed = found.join(F.broadcast(df), "leaf").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("mean")))
    prefix = [leaf for leaf, (_, _, kind, _) in enumerate(leaves) if kind == "prefix"]
    wanted = [leaf for leaf, (n, i, _, _) in enumerate(leaves) if i in known[n][1].wanted]
    scored = F.when(~F.col("leaf").isin(wanted), 0.0).when(F.col("leaf").isin(prefix), 1.0).otherwise(part)
    each = weighed.groupBy(key, "q").agg(F.sum(scored).alias("score"), F.collect_set("leaf").alias("has"))
    tests = [(F.col("q") == n) & q.test(lambda i, n=n: F.array_contains("has", place[n, i])) for n, (_, q) in enumerate(known)]
    names = F.array(*(F.lit(text) for text, _ in known))
    return each.where(_any(tests) & F.arrays_overlap("has", F.array(*map(F.lit, wanted)))).select(key, F.round("score", 6).alias("score"), F.get(names, F.col("q")).alias("query"))
