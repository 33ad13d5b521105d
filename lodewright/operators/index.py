"""Phrase and term search over a table of documents, and how much of a benchmark it contains."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.tokens import ngrams, term_line, terms

#: Terms of the piece of a phrase that it is looked up by; the whole phrase is checked afterwards.
ANCHOR = 5
#: Pieces that are sought in the documents before rows are made of their n-grams; with more, all n-grams are joined.
ANCHORS = 1000


def _phrase(spark: SparkSession, phrases: list[str]) -> list[list[str]]:
    rows = spark.createDataFrame(list(enumerate(phrases)), "i int, s string").select("i", terms("s").alias("t")).collect()
    return [r["t"] or [] for r in sorted(rows, key=lambda r: r["i"])]


@F.pandas_udf(BooleanType())
def _near(tokens: pd.Series, phrase: pd.Series, slop: pd.Series) -> pd.Series:
    return pd.Series([near(list(t), list(p), int(s)) if t is not None else False for t, p, s in zip(tokens, phrase, slop)])


def near(tokens: list[str], phrase: list[str], slop: int) -> bool:
    """Whether the phrase's terms can be placed so that their shifts against the phrase span at most ``slop`` positions.

    Two terms in order may have ``slop`` terms between them; a swap costs two. Each term takes a place of its own: a
    matching of terms and places is grown by exchanges, as terms that are repeated compete for places.
    """
    if not phrase:
        return False
    at: dict[str, list[int]] = {t: [] for t in phrase}
    for i, t in enumerate(tokens):
        if t in at:
            at[t].append(i)
    if not all(len(at[t]) >= phrase.count(t) for t in at):
        return False
    for start in sorted({i - k for k, t in enumerate(phrase) for i in at[t]}):  # the smallest shift of a match
        windows = []
        for k, t in enumerate(phrase):
            own = at[t]
            windows.append(own[bisect_left(own, start + k) : bisect_right(own, start + slop + k)])
            if not windows[-1]:
                break
        else:
            taken: dict[int, int] = {}
            if all(_place(k, windows, taken) for k in range(len(phrase))):
                return True
    return False


def _place(first: int, windows: list[list[int]], taken: dict[int, int]) -> bool:
    """Gives term ``first`` a place, moving terms that have one; ``taken`` (place -> term) grows by one if it can."""
    came: dict[int, int] = {}  # place -> the term that asked for it
    left = [first]
    while left:
        k = left.pop()
        for i in windows[k]:
            if i in came:
                continue
            came[i] = k
            if i not in taken:
                held = {term: place for place, term in taken.items()}
                while True:  # every term on the way moves on to the place that it asked for
                    k = came[i]
                    taken[i] = k
                    if k == first:
                        return True
                    i = held[k]
            left.append(taken[i])
    return False


def whole_term(pattern: str):
    """Whether the pattern matches a term from its first character to its last, in any case."""
    return lambda t: (t != "") & F.rlike(t, F.lit(f"(?i)^(?:{pattern})$"))


class CorpusIndex:
    """Search over ``df``: columns ``id`` and ``text``, and others to filter and sort by.

    Texts are analysed into lower-case words without punctuation. subset_filter: column -> value, all of which must
    be equal. Given as text alone the terms are computed for each search; a table with a column ``term_line`` (from
    analysed(), written once) is searched without.
    """

    def __init__(self, df: DataFrame, ids: str = "id", text: str = "text"):
        self.df, self.ids, self.text = df, ids, text

    def analysed(self) -> DataFrame:
        return self.df if "term_line" in self.df.columns else self.df.withColumn("term_line", term_line(self.text))

    def _line(self) -> Column:
        return F.col("term_line") if "term_line" in self.df.columns else term_line(self.text)

    def _filtered(self, subset_filter: dict | None) -> DataFrame:
        out = self.df
        for name, value in (subset_filter or {}).items():
            out = out.where(F.col(name) == F.lit(value))
        return out

    def predicate(self, phrases: str | list[str], all_phrases: bool = False, is_regexp: bool = False, slop: int = 0) -> Column:
        """A document holds any of the phrases, or all of them.

        A regular expression matches one whole term in any case. A phrase without terms matches nothing.
        """
        own = [phrases] if isinstance(phrases, str) else list(phrases)
        if is_regexp:
            split = F.split(F.trim(self._line()), " ")
            tests = [F.exists(split, whole_term(p)) for p in own]
        elif slop:
            tests = [_near(self._candidate(t), F.array(*map(F.lit, t)), F.lit(slop)) if t else F.lit(False) for t in _phrase(self.df.sparkSession, own)]
        else:
            tests = [F.contains(self._line(), F.lit(f" {' '.join(t)} ")) if t else F.lit(False) for t in _phrase(self.df.sparkSession, own)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if all_phrases else out | t
        return F.coalesce(out, F.lit(False))

    def _candidate(self, phrase: list[str]) -> Column:
        """The terms of a text that has all terms of the phrase, else null: only such texts go to Python."""

        def split(line: Column) -> Column:
            there = F.lit(True)
            for t in sorted(set(phrase)):
                there = there & F.contains(line, F.lit(f" {t} "))
            return F.when(there, F.filter(F.split(line, " "), lambda t: t != ""))

        return F.get(F.transform(F.array(self._line()), split), F.lit(0))  # the line is a variable, made once

    def documents(self, phrases: str | list[str], all_phrases: bool = False, is_regexp: bool = False, slop: int = 0, subset_filter: dict | None = None) -> DataFrame:
        return self._filtered(subset_filter).where(self.predicate(phrases, all_phrases, is_regexp, slop))

    def count_documents_containing_phrases(self, phrases: str | list[str], all_phrases: bool = False, is_regexp: bool = False, slop: int = 0, subset_filter: dict | None = None) -> int:
        return self.documents(phrases, all_phrases, is_regexp, slop, subset_filter).count()

    def get_documents_containing_phrases(self, phrases: str | list[str], all_phrases: bool = False, num_documents: int = 10, is_regexp: bool = False, slop: int = 0, return_all_hits: bool = False, sort_field: str | None = None, subset_filter: dict | None = None) -> Iterator:
        """The first ``num_documents`` hits by id, or all of them by ``sort_field`` and id, a partition at a time."""
        found = self.documents(phrases, all_phrases, is_regexp, slop, subset_filter)
        if return_all_hits:
            yield from found.orderBy(*[c for c in (sort_field, self.ids) if c]).toLocalIterator()
        else:
            yield from found.orderBy(self.ids).limit(num_documents).collect()

    def count_documents_for_each_phrase(self, phrases: list[str] | list[list[str]], all_phrases: bool = False, subset_filter: dict | None = None) -> list[int]:
        """Document counts in the order of ``phrases``; with all_phrases each is a list of phrases, all of which must be there."""
        if isinstance(phrases, str):
            phrases = [phrases]
        if not phrases or not all(isinstance(p, list if all_phrases else str) for p in phrases):
            raise TypeError("lists of strings are needed" if all_phrases else "strings are needed")
        rows = [(i, k, p) for i, own in enumerate(phrases) for k, p in enumerate(own if all_phrases else [own])]
        probes = self.df.sparkSession.createDataFrame(rows, "i long, k long, text string")
        found = {r["i"]: r["documents"] for r in self.document_counts(probes, "i", "k", subset_filter).collect()}
        return [found.get(i, 0) for i in range(len(phrases))]

    def hits(self, probes: DataFrame, probe: str, part: str | None = None, subset_filter: dict | None = None) -> DataFrame:
        """(probe, part, id): documents that contain each probe (columns ``probe``, ``part``, text) as a phrase.

        No pair of document and probe is tried: a probe is looked up by its first ANCHOR terms among the n-grams of the
        documents, in an equi-join, and the documents found so are checked for the whole phrase.
        """
        cut = probes.select(F.col(probe).alias("probe"), (F.col(part) if part else F.lit(0)).cast("long").alias("part"), terms("text").alias("t"))
        cut = cut.where(F.size("t") > 0).withColumn("n", F.least(F.size("t"), F.lit(ANCHOR)))
        cut = cut.select("probe", "part", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("phrase"), (F.size("t") > ANCHOR).alias("more"), "n", F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("anchor"))
        docs = self._filtered(subset_filter).where(F.col(self.text).isNotNull()).select(F.col(self.ids).alias("id"), self._line().alias("line"))
        split = docs.select("id", "line", F.filter(F.split("line", " "), lambda t: t != "").alias("t"))
        sizes = sorted(r["n"] for r in cut.select("n").distinct().collect())  # at most ANCHOR of them
        if not sizes:
            return docs.select(F.lit(None).cast("string").alias("probe"), F.lit(0).cast("long").alias("part"), "id").where(F.lit(False))
        grams = F.array_distinct(F.concat(*[ngrams("t", n) for n in sizes]))
        wanted = [r["anchor"] for r in cut.select("anchor").distinct().limit(ANCHORS + 1).collect()]
        if len(wanted) <= ANCHORS:
            # few enough to be told from all others before a row is made of each; the line comes along with the hits
            grams = F.filter(grams, lambda g: g.isin(*wanted))
            found = split.select("id", "line", F.explode(grams).alias("anchor")).join(cut, "anchor")
            return found.where(~F.col("more") | F.contains("line", F.col("phrase"))).select("probe", "part", "id").distinct()
        found = split.select("id", F.explode(grams).alias("anchor")).join(cut, "anchor").select("probe", "part", "phrase", "more", "id")
        sure = found.where(~F.col("more")).select("probe", "part", "id")
        check = found.where("more").join(docs, "id").where(F.contains("line", F.col("phrase"))).select("probe", "part", "id")
        return sure.unionByName(check).distinct()

    def document_counts(self, probes: DataFrame, probe: str, part: str | None = None, subset_filter: dict | None = None) -> DataFrame:
        """(probe, documents) for every probe: how many documents contain it, or all of its parts in the same document."""
        found = self.hits(probes, probe, part, subset_filter)
        parts = probes.groupBy(F.col(probe).alias("_p")).agg(F.count("*").alias("_parts"))
        if part:
            found = found.groupBy("probe", "id").agg(F.count("*").alias("_got")).join(parts, F.col("probe") == F.col("_p")).where(F.col("_got") == F.col("_parts")).select("probe", "id")
        counted = found.groupBy("probe").agg(F.count("*").alias("documents"))
        return parts.join(counted, F.col("_p") == F.col("probe"), "left").select(F.col("_p").alias(probe), F.coalesce("documents", F.lit(0)).alias("documents"))

    def contamination(self, probes: DataFrame, probe: str, part: str | None = None) -> DataFrame:
        """n, contaminated, percentage: probes of which a document has the whole text (or all parts)."""
        hit = (F.col("documents") > 0).cast("int")
        return self.document_counts(probes, probe, part).agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("contaminated"), (100 * F.avg(hit)).alias("percentage"))

    def term_frequencies(self, words: Iterable[str]) -> DataFrame:
        """(term, count): how often each word occurs in all texts; words are lower-cased, and absent ones have 0."""
        spark = self.df.sparkSession
        asked = spark.createDataFrame([(w.lower(),) for w in words], "term string").distinct()
        split = F.explode(F.filter(F.split(self._line(), " "), lambda t: t != ""))
        seen = self.df.select(split.alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("count"))
        return asked.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("count"))

    def count_total_occurrences_of_unigrams(self, words: Iterable[str]) -> dict[str, int]:
        return {r["term"]: r["count"] for r in self.term_frequencies(words).collect()}

    def get(self, *ids) -> DataFrame:
        """The documents with these ids."""
        return self.df.where(F.col(self.ids).isin(*ids))

    def random(self, n: int, seed: int | None = None, replacement: bool = False) -> DataFrame:
        """n documents drawn evenly, without replacement unless asked for; with it, a document drawn twice comes twice."""
        if replacement:
            # independent counts of mean ``rate`` that come to n or more; any n of their draws are n even draws
            total = self.df.count()
            return (self.df.sample(True, (n + 6 * n**0.5 + 20) / total, seed) if total else self.df).withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")
        return self.df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def tables(spark: SparkSession, pattern: str = "*", properties: bool = False) -> DataFrame:
    """(index, documents[, properties]): the catalog's tables by name pattern, with their row counts."""
    rows = []
    for t in spark.catalog.listTables(pattern=pattern):
        if not t.name.startswith("."):
            df = spark.table(t.name)
            rows.append((t.name, df.count(), df.columns))
    out = spark.createDataFrame(rows, "index string, documents long, properties array<string>")
    return out if properties else out.drop("properties")


def union_of(spark: SparkSession, pattern: str) -> DataFrame:
    """The rows of all tables whose name fits the pattern (* for any run of characters)."""
    out = None
    for t in spark.catalog.listTables(pattern=pattern):
        out = spark.table(t.name) if out is None else out.unionByName(spark.table(t.name), allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no table fits {pattern!r}")
    return out
