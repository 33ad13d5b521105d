"""python -m lodewright.cli COMMAND: the corpus commands and the count analyses over JSON-lines files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .functions.tokens import tokenizer
from .operators import counts, ngrams, pii, profanity, search, stats
from .session import session
from .sources import corpus, sinks

ANALYSES = ("schemes", "urls", "url-tokens", "suffixes", "extensions", "years", "lengths", "pii", "profanity", "hashes")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodewright", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, tokens: bool = True, output: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text, description=text)
        if name == "analyze":
            p.add_argument("analysis", choices=ANALYSES)
        p.add_argument("paths", nargs="+", help="files, or directories with *.json*.gz files below them")
        p.add_argument("-l", "--limit", type=int, help="lines of each file at most")
        p.add_argument("--file-limit", type=int, help="files at most")
        p.add_argument("-j", "--workers", help="local threads; by default the Spark master of the environment")
        p.add_argument("--json", action="store_true", help="print JSON lines")
        p.add_argument("-q", "--quiet", action="store_true", help="print nothing")
        if tokens:
            p.add_argument("-t", "--tokenizer", default="unicode", help="unicode, a registered name, or a tokenizer file")
        if output:
            p.add_argument("-o", "--out", help="folder or file for JSON lines")
            p.add_argument("-f", "--force", action="store_true", help="replace what is there")
        return p

    for name, text in (("topk", "most common n-grams"), ("botk", "least common n-grams"), ("unique", "number of different n-grams")):
        p = command(name, text, output=name != "unique")
        p.add_argument("-n", "--ngram", type=int, default=3)
        p.add_argument("--approximate", action="store_true", help="sketches instead of exact counts")
        p.add_argument("--size", default="4GiB", help="sketch budget; used with --approximate alone")
        p.add_argument("--hashes", type=int, default=5, help="for compatibility; exact counts need none")
        p.add_argument("--seed", type=int)
        if name != "unique":
            p.add_argument("-k", "--topk", dest="k", type=int, default=20)
            p.add_argument("--threshold", type=int, default=1 if name == "topk" else 4_294_967_295)
            p.add_argument("--u64", action="store_true", help="for compatibility; counts are always 64 bits wide")
        if name == "botk":
            p.add_argument("--p-keep", type=float, default=1.0)
    p = command("count", "occurrences of token sequences")
    p.add_argument("-s", "--search", action="append", required=True)
    p = command("search", "matches of regular expressions", tokens=False)
    p.add_argument("-p", "--pattern", action="append", required=True)
    p.add_argument("--with-locations", action="store_true")
    p.add_argument("--locations-limit", type=int)
    command("stats", "summary of a corpus")
    p = command("analyze", "counts by a key of each document", tokens=False)
    p.add_argument("--lexicon", help="CSV with word and categorization, for profanity")
    return out


def size_bytes(text: str) -> int:
    """4GiB, 512MB, 2: bytes; a bare number is GiB."""
    units = {"": 1 << 30, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}
    digits = text.strip().rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ")
    unit = text.strip()[len(digits) :].strip().lower()
    if unit not in units or not digits:
        raise ValueError(f"not a size: {text!r}")
    return int(float(digits) * units[unit])


def _schema(analysis: str) -> StructType:
    own = {"schemes": ["url"], "urls": ["url"], "url-tokens": ["url", "text"], "suffixes": ["url"], "extensions": ["url"], "years": ["date", "timestamp", "created"]}
    return StructType([StructField(n, StringType()) for n in own.get(analysis, ["text"])])


def _analysis(a: argparse.Namespace, df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return {
        "schemes": lambda: counts.schemes(df),
        "urls": lambda: counts.locations(df),
        "url-tokens": lambda: counts.location_tokens(df),
        "suffixes": lambda: counts.public_suffix_counts(counts.locations(df)),
        "extensions": lambda: counts.extensions(df),
        "years": lambda: counts.years(df, "date", "timestamp", "created"),
        "lengths": lambda: counts.lengths(df),
        "pii": lambda: pii.counts(df),
        "profanity": lambda: profanity.taxonomy(df, corpus.lexicon(spark, a.lexicon)),
        "hashes": lambda: counts.text_keys(df),
    }[a.analysis]()


def result(a: argparse.Namespace) -> DataFrame:
    """What the parsed command computes, as a DataFrame."""
    for name in ("k", "ngram", "hashes"):
        if getattr(a, name, 1) < 1:
            raise ValueError(f"{name} must be 1 or more")
    if getattr(a, "locations_limit", None) is not None and not a.with_locations:
        raise ValueError("--locations-limit needs --with-locations")
    if a.command == "analyze" and a.analysis == "profanity" and not a.lexicon:
        raise ValueError("profanity needs --lexicon")
    spark = session(f"local[{a.workers}]" if a.workers else None)
    positions = a.command == "stats" or getattr(a, "with_locations", False)
    schema = _schema(a.analysis) if a.command == "analyze" else corpus.TEXT
    df = corpus.documents(spark, a.paths, schema, limit=a.limit, file_limit=a.file_limit, positions=positions)
    tokens = tokenizer(a.tokenizer) if hasattr(a, "tokenizer") else None
    if a.command == "topk":
        tracked = max(a.k, min(1 << 20, size_bytes(a.size) // 64))
        return ngrams.approximate_topk(df, a.ngram, a.k, tracked, tokens=tokens) if a.approximate else ngrams.topk(df, a.ngram, a.k, a.threshold, tokens=tokens)
    if a.command == "botk":
        return ngrams.botk(df, a.ngram, a.k, a.threshold, a.p_keep, a.seed, tokens=tokens)
    if a.command == "unique":
        return (ngrams.approximate_unique if a.approximate else ngrams.unique)(df, a.ngram, tokens=tokens)
    if a.command == "count":
        return search.count_sequences(df, a.search, tokens=tokens)
    if a.command == "search":
        return search.locations(df, a.pattern, ["path", "line"], limit=a.locations_limit) if a.with_locations else search.count_patterns(df, a.pattern)
    if a.command == "stats":
        if a.tokenizer == "unicode":
            return stats.summary(df, raw="raw")
        from pyspark.sql import functions as F

        return stats.summary(df, raw="raw", count=lambda t: F.size(tokens(t)).cast(LongType()))
    return _analysis(a, df)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        out = None
        if getattr(a, "out", None):
            out = a.out
            if not Path(out).suffix and a.command in ("topk", "botk"):
                out = sinks.auto_name(out, a.ngram, a.k, a.hashes, a.limit, a.seed)
        df = result(a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    df = df.persist() if out and not a.quiet else df
    if out:
        sinks.write_json(df, out, a.force)
    if not a.quiet:
        if a.command in ("topk", "botk") and not a.json:
            print("\n".join(sinks.shown(df.orderBy("rank").collect())) or "no n-gram passes the threshold")
        else:
            for row in sinks.json_records(df).toLocalIterator():
                print(row["value"] if a.json else " | ".join(f"{k}: {v}" for k, v in json.loads(row["value"]).items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
