"""Personal data: e-mail addresses, phone numbers and IP addresses, judged by what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank

# The patterns, looked for in lower-cased text, and what marks a document as no prose.
EMAIL = r"[.\s@,?!;:)(]*([^\s@]+@[^\s@,?!;:)(]+?)[.\s@,?!;:)(]?[\s\n\r]"
PHONE = r"\s+\(?(\d{3})\)?[-\. ]*(\d{3})[-. ]?(\d{4})"
IP = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
URL = (
    r"https?://(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|https?://(?:www\.|(?!www))[a-zA-Z0-9]+\.[^\s]{2,}|www\.[a-zA-Z0-9]+\.[^\s]{2,}"
)
AROUND, CONTEXT_WORDS = 50, ("isbn", "doi", "#")
MOST_CHARS = 500_000
CONTAINED = ("." * 45, "!" * 99, "# # # # # # #", "?" * 7, "," * 76, ":)" * 52, ";" * 121)
OFTEN = (("." * 11, 50), ("/ / / / /", 50), ("%", 1000))


def junk(text: str = "text") -> Column:
    """Very long, or full of rulers and repeated marks."""
    t = F.col(text)
    out = F.length(t) > MOST_CHARS
    for piece in CONTAINED:
        out = out | F.contains(t, F.lit(piece))
    for piece, most in OFTEN:  # occurrences don't overlap, so what they leave tells their number
        out = out | ((F.length(t) - F.length(F.replace(t, F.lit(piece)))) > F.lit(most * len(piece)))
    return out


def _clear(window: Column, url: bool) -> Column:
    out = F.lit(True)
    for word in CONTEXT_WORDS:
        out = out & ~F.contains(window, F.lit(word))
    return out & ~F.rlike(window, F.lit(URL)) if url else out


def _window(text: Column, match: Column) -> Column:
    """Lower-cased text from AROUND code points before the first place of ``match`` in ``text`` to AROUND after it.

    A match that isn't in the text as it stands is taken to be at place -1, so that the head of the text is judged.
    """
    at = F.instr(text, match) - 1
    low = F.greatest(F.lit(0), at - AROUND)
    return F.lower(F.substring(text, low + 1, F.greatest(F.lit(0), at + F.length(match) + AROUND - low)))


def matches(df: DataFrame, text: str = "text") -> DataFrame:
    """df with emails, phone_numbers and IP_addresses: arrays of what passes the rules, a phone number as its ten digits.

    Blank and junk documents are left out. An address needs something before the @ and a dot behind it. Near a phone
    number (and an IP address) no ISBN, DOI or # may stand, and near a phone number no URL; see _window().
    """
    t, low = F.col(text), F.lower(text)
    found = df.where(~blank(text) & ~junk(text))
    has = F.contains(t, F.lit("@"))  # the pattern is slow on long words without one
    emails = F.when(has, F.regexp_extract_all(low, F.lit(EMAIL), F.lit(1))).otherwise(F.array().cast("array<string>"))
    groups = [F.regexp_extract_all(low, F.lit(PHONE), F.lit(i)) for i in (1, 2, 3)]
    phones = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))
    ips = F.regexp_extract_all(low, F.lit(IP), F.lit(0))
    found = found.withColumns({"_e": emails, "_p": phones, "_i": ips})
    part = lambda m, i: F.element_at(F.split(m, "@"), i)
    return found.withColumns(
        {
            "emails": F.filter("_e", lambda m: (part(m, 1) != "(") & F.contains(part(m, 2), F.lit("."))),
            "phone_numbers": F.filter("_p", lambda m: _clear(_window(t, m), True)),
            "IP_addresses": F.filter("_i", lambda m: _clear(_window(t, m), False)),
        }
    ).drop("_e", "_p", "_i")


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(pii, count): passing matches of each kind over all documents; kinds without one are left out. One row a task."""
    kinds = {"email": "emails", "phone_numbers": "phone_numbers", "IP_addresses": "IP_addresses"}
    totals = matches(df, text).agg(*[F.sum(F.size(c)).cast("long").alias(k) for k, c in kinds.items()])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pii"), F.col(k).alias("count")) for k in kinds]))).where(F.col("count") > 0)
