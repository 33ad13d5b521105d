"""Secrets in whole texts: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A run of MIN_RUN characters or more is random if a token of it holds fewer characters than RATIO on average.
MIN_RUN, RATIO = 20, 1.9

_ASSIGN = re.compile(
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A greedy run that is too short is dropped, which a lower bound on its length does as well.
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")
_RUN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_UUID = re.compile("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile("(?:md5|sha1|sha224|sha256|sha384|sha512)?[-_=/]?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
#: Fixed value: how the vocabulary's tokenizer splits a text before it merges bytes.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
#: Padding and joining marks.
_MARKS = "=_-+/"
#: What is cut out of a run before its pieces are tested.
_KNOWN = re.compile(f"{_UUID.pattern}|(?<![A-Za-z0-9])(?:{_DIGEST.pattern})(?![A-Za-z0-9])")
#: Subresource integrity: sha256-<base64>.
_INTEGRITY = re.compile("sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
#: Words joined by case, _, - or /, with a number after a word: names in code and paths.
#: Nothing is given back once it has matched, so that the time is linear; of capitals before a word, the last one begins it.
_NAME = re.compile("/*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}(?=[A-Z][a-z])|[A-Z]{2,}+(?![a-z]))[0-9]{0,4}+(?![0-9])[_/=+-]*+)++")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary file is; scan() takes any other path."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise RuntimeError("no vocabulary files are installed here: give scan() the path of a file of ranks, the same on every executor") from e
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def known(run: str) -> bool:
    """Digests, UUIDs and identifiers, which are long or look random but are no secrets by themselves."""
    return bool(_UUID.fullmatch(run) or _DIGEST.fullmatch(run) or _INTEGRITY.fullmatch(run) or _NAME.fullmatch(run)) or run.isdigit()


def pieces(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, string) of what is left of each maximal run without UUIDs, digests and the spans in ``taken``."""
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for a, b, _ in taken):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    first = 0
    for m in _RUN.finditer(text):
        while first < len(merged) and merged[first][1] <= m.start():
            first += 1
        gone, k = [], first
        while k < len(merged) and merged[k][0] < m.end():
            gone.append(tuple(merged[k]))
            k += 1
        if not known(m[0].strip(_MARKS)):
            gone += [(m.start() + x.start(), m.start() + x.end()) for x in _KNOWN.finditer(m[0])]
        low = m.start()
        for a, b in sorted(gone):
            if a > low:
                yield low, text[low:a]
            low = max(low, b)
        if low < m.end():
            yield low, text[low : m.end()]


def random_spans(text: str, path: str, ratio: float = RATIO, taken: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """Runs of letters, digits and +/_=- whose characters a token are few, unless they are known().

    UUIDs, digests and the spans in ``taken`` are cut out of a maximal run, and each piece that is left is tested by
    itself. It needs two of lower case, upper case and digits: rulers and words are no keys. Padding and joining marks
    at its ends don't count.
    """
    out = []
    for start, piece in pieces(text, taken):
        run = piece.strip(_MARKS)
        low = start + piece.index(run) if run else 0
        if len(run) < MIN_RUN or sum((run.lower() != run, run.upper() != run, any(c.isdigit() for c in run))) < 2 or known(run):
            continue
        if len(run) < ratio * len(encoding(path).encode_ordinary(run)):
            out.append((low, low + len(run), "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, secrets for every row of docs.

    Base kinds are the leftmost non-overlapping matches of each pattern in the whole text. The token-efficiency test
    adds spans of kind ``random`` that lie in no base span. Positions are code points, the end exclusive. secrets holds
    the matched strings in the order of spans. Null and empty texts have none; repeated rows are scanned as they come.
    The vocabulary file must be on every executor, at ``path``. Columns other than doc_id and text are not looked at.
    """
    where = path or vocabulary_path()

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "secrets")}
        for raw in batch.column("text").to_pylist():
            text = (raw or b"").decode("utf-8", "replace")
            base = base_spans(text)
            more = random_spans(text, where, ratio, base)
            kinds = [k for _, _, k in base]
            every = joined(base + more)
            for k, v in zip(out, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), every, len(more), [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in every.split(",") if s)])):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return by_batch(cut, work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, secrets array<string>")
