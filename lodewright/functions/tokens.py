"""Tokenizers and n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts are looked up from U+2E80 on: below it there is neither Han nor Hiragana, and the look-up is slow.
_LETTERS = r"[a-zA-Z[\p{L}\p{M}&&[^\x{2E80}-\x{10FFFF}]][\p{L}\p{M}&&[\x{2E80}-\x{10FFFF}]&&[^\p{IsHan}\p{IsHiragana}]]]++"
_ONE = r"[\x{2E80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}]]"
#: Plain words, which the rest would match as well, only slower.
_PLAIN = r"[a-zA-Z]++(?=[ \n]|[,.!?;]\s)"
_WORD = rf"{_PLAIN}|(?:{_LETTERS}(?:[.'’:·]{_LETTERS})*+|\p{{N}}++(?:[.'’,;]\p{{N}}++)*+|_++)++|{_ONE}"

#: Unicode default word boundaries without white space. Quantifiers are possessive: a long token that alternates letters
#: and digits would otherwise end the JVM with a stack overflow.
UNICODE = rf"{_WORD}|[^\s\p{{Z}}\p{{L}}\p{{N}}\p{{M}}_]"
#: The same without punctuation, as a search index analyses text.
TERMS = _WORD
#: Runs of word characters, and runs of other characters that aren't white space.
WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: White space that is a segment of its own and not a single space.
OTHER_SPACE = r"\r\n|[\t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: From here on n-grams are cut by a lambda: so many shifted copies of the tokens would make a huge plan.
MOST_SHIFTS = 12


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: str | Column) -> Column:
    """White space cut off at both ends; trim() alone knows only the space."""
    return F.regexp_replace(col(text), r"^[\s\p{Z}]++|[\s\p{Z}]++$", "")


def unicode_tokens(text: str | Column) -> Column:
    """Words and punctuation marks in order, case kept; null for null."""
    return F.regexp_extract_all(col(text), F.lit(UNICODE), F.lit(0))


def unicode_count(text: str | Column) -> Column:
    """size(unicode_tokens(text)) without building the array; null for null."""
    return F.regexp_count(col(text), F.lit(UNICODE)).cast("long")


def terms(text: str | Column) -> Column:
    """Lower-case words without punctuation, as searched."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERMS), F.lit(0))


def term_line(text: str | Column) -> Column:
    """The terms between single spaces, one before and one after: a phrase is contained as ' its terms '."""
    return F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))


def wordpunct_count(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(WORDPUNCT)).cast("long")


def segment_count(text: str | Column) -> Column:
    """Word-boundary segments other than a single space: tokens, and each other white-space character (CR LF is one)."""
    return unicode_count(text) + F.regexp_count(col(text), F.lit(OTHER_SPACE)).cast("long")


def sentences(text: str | Column) -> Column:
    """Pieces that end in . ! ? or 。 and white space."""
    return F.filter(F.split(strip(text), r"(?<=[.!?。])\s++"), lambda s: s != "")


def ngrams(tokens: str | Column, n: int, separator: str = " ") -> Column:
    """All runs of n consecutive tokens as joined strings; an empty array where there are fewer tokens."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    t = col(tokens)
    if n == 1:
        return t
    count = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    if n <= MOST_SHIFTS:
        # copies shifted by 0..n-1 side by side: stays in generated code, which a lambda with slices doesn't
        shifted = F.arrays_zip(*[F.slice(t, F.lit(i + 1), count) for i in range(n)])
        return F.transform(shifted, lambda s: F.concat_ws(separator, *[s.getField(f"{i}") for i in range(n)]))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(t, i, n), separator))).otherwise(F.array().cast("array<string>"))


def exploded_ngrams(df, tokens: str | Column, n: int, *keep: str, separator: str = " "):
    """A row for each n-gram of each row of df: the columns ``keep`` and ``ngram``."""
    t = col(tokens)
    if n == 1:
        return df.select(*keep, F.explode(t).alias("ngram"))
    if n > MOST_SHIFTS:
        return df.select(*keep, F.explode(ngrams(t, n, separator)).alias("ngram"))
    slim = df.select(*keep, t.alias("_tokens")).withColumn("_count", F.greatest(F.size("_tokens") - F.lit(n - 1), F.lit(0)))
    shifted = F.arrays_zip(*[F.slice("_tokens", F.lit(i + 1), F.col("_count")) for i in range(n)])
    rows = slim.select(*keep, F.explode(shifted).alias("_s"))
    return rows.select(*keep, F.concat_ws(separator, *[F.col(f"_s.{i}") for i in range(n)]).alias("ngram"))


@dataclass
class Pieces:
    """Rows of n-grams: the columns of ``df`` that hold their tokens, null where a document has no more; one column, joined, for large n."""

    df: DataFrame
    pieces: list[Column]
    separator: str

    def joined(self) -> Column:
        return F.concat_ws(self.separator, *self.pieces) if len(self.pieces) > 1 else self.pieces[0]


def ngram_pieces(df: DataFrame, tokens: str | Column, n: int, *keep: str, separator: str = " ", whole: bool = False) -> Pieces:
    """A row for each token of each row of df, with the n - 1 that follow it: the columns ``keep``, and pieces.

    With ``whole`` (or large n) only those that have so many.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    t = col(tokens)
    if n == 1:
        return Pieces(df.select(*keep, F.explode(t).alias("_s")), [F.col("_s")], separator)
    if n > MOST_SHIFTS:
        return Pieces(df.select(*keep, F.explode(ngrams(t, n, separator)).alias("_s")), [F.col("_s")] * n, separator)
    slim = df.select(*keep, t.alias("_tokens")).withColumn("_count", F.greatest(F.size("_tokens") - F.lit(n - 1), F.lit(0)))
    size = [F.col("_count") if whole else F.greatest(F.size("_tokens") - F.lit(i), F.lit(0)) for i in range(n)]
    shifted = F.arrays_zip(*[F.slice("_tokens", F.lit(i + 1), size[i]) for i in range(n)])
    return Pieces(slim.select(*keep, F.explode(shifted).alias("_s")), [F.col(f"_s.{i}") for i in range(n)], separator)


_registry: dict[str, Callable[[str | Column], Column]] = {"unicode": unicode_tokens}


def register_tokenizer(name: str, tokens: Callable[[str | Column], Column]) -> None:
    """Makes ``tokens``, a function of a text column that gives an array of strings, known by name."""
    _registry[name] = tokens


def tokenizer(name: str = "unicode") -> Callable[[str | Column], Column]:
    """A registered tokenizer, or that of a tokenizer file (JSON) at a path that every executor can read."""
    if name in _registry:
        return _registry[name]
    if name.endswith(".json"):
        return pretrained(name)
    raise ValueError(f"no tokenizer named {name!r}; known: {', '.join(sorted(_registry))}, or a path to a .json file")


@lru_cache(maxsize=4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def pretrained(path: str) -> Callable[[str | Column], Column]:
    """The tokens of a tokenizer file, decoded one by one, without special tokens; loaded once a worker."""

    @F.pandas_udf("array<string>")
    def encode(texts: pd.Series) -> pd.Series:
        own = _loaded(path)
        out = []
        for x in texts:
            out.append(None if x is None else [own.decode([i], skip_special_tokens=False) for i in own.encode(x, add_special_tokens=False).ids])
        return pd.Series(out, index=texts.index)

    return lambda text: encode(col(text))
