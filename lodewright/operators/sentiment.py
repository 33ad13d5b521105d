"""Mean polarity of the sentences that mention demographic terms."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.tokens import sentences, unicode_tokens
from ..functions.values import blank, too_long

# The terms looked for. ``person`` is listed twice and counts twice.
MALE = ["he", "him", "his", "himself"]
FEMALE = ["she", "her", "hers", "herself"]
RELIGIOUS = ["muslim", "christian", "athiest", "buddhist", "hindu", "jew"]
RACIAL = ["asian", "hispanic", "latino"]
BASE_RACIAL = ["white", "black"]
PERSONS = ["person", "man", "woman", "person", "boy", "girl", "child", "children", "people", "men", "women"]

#: A few English words by polarity, for use where no scorer is given.
POLARITY = {"good": 0.7, "great": 0.8, "excellent": 1.0, "happy": 0.8, "love": 0.5, "nice": 0.6, "best": 1.0, "beautiful": 0.85, "bad": -0.7, "terrible": -1.0, "awful": -1.0, "sad": -0.5, "hate": -0.8, "worst": -1.0, "poor": -0.4, "ugly": -0.7}


@F.pandas_udf(DoubleType())
def lexicon_polarity(sentence: pd.Series) -> pd.Series:
    """Mean polarity of the words that have one, halved and turned after ``not``; 0 without any."""

    def one(x: str | None) -> float:
        words, values = (x or "").lower().split(), []
        for before, w in zip(["", *words], words):
            v = POLARITY.get(w.strip(".,;:!?\"'()"))
            if v is not None:
                values.append(-v / 2 if before == "not" else v)
        return sum(values) / len(values) if values else 0.0

    return sentence.map(one)


def terms(extended: bool = True) -> list[tuple[str, str, str]]:
    """(how, term, name): how a term is looked for and under which name it is reported."""
    out = [("token", t, "male") for t in MALE] + [("token", t, "female") for t in FEMALE] + [("plural", t, t) for t in RELIGIOUS] + [("part", t, t) for t in RACIAL]
    return out + [("part", f"{a} {b}", a) for a in BASE_RACIAL for b in PERSONS] if extended else out


def co_occurrence(df: DataFrame, polarity: Callable[[Column], Column] = lexicon_polarity, text: str = "text") -> DataFrame:
    """(term, sentiment, count): mean polarity of the sentences with each term, and how many times it was counted.

    Gender terms are whole tokens, religious ones whole tokens with or without s, racial ones any part of a sentence,
    all in the case given. A sentence counts once for each term listed, so that a name collects all of its terms. Blank
    and over-long texts are left out. Only sentences with a term reach the scorer.
    """
    # a filter on the names themselves would be pushed below the tokens and find them anew for each term
    whole = "|".join([*MALE, *FEMALE, *(f"{t}s?" for t in RELIGIOUS)])
    some = F.rlike("s", F.lit(rf"(?U)\b(?:{whole})\b|{'|'.join([*RACIAL, *(f'{a} ' for a in BASE_RACIAL)])}"))
    rows = df.where(~blank(text) & ~too_long(text)).select(F.explode(sentences(text)).alias("s")).where(some).withColumn("t", unicode_tokens("s"))
    how = {
        "token": lambda t: F.array_contains("t", t),
        "plural": lambda t: F.array_contains("t", t) | F.array_contains("t", t + "s"),
        "part": lambda t: F.contains("s", F.lit(t)),
    }
    names = F.array_compact(F.array(*[F.when(how[h](t), F.lit(name)) for h, t, name in terms()]))
    found = rows.select("s", names.alias("names")).select("names", polarity(F.col("s")).alias("p"))
    return found.select(F.explode("names").alias("term"), "p").groupBy("term").agg(F.avg("p").alias("sentiment"), F.count("*").alias("count"))
