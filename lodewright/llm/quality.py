"""Quality classifier from weak labels: heuristics vote, EM weighs them, and their posterior trains a hashed scorer."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .common import Veil, by_batch, least_share, saved, text_once

#: Documents that train the scorer at most, and features of the scorer.
SAMPLE, BUCKETS = 6000, 1 << 14
ROUNDS, STEPS, SEED = 60, 300, 11

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—…¿¡«»„“”’]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _vote(value: float, bad: float, good: float) -> str:
    """'-' (poor) from ``bad`` on, '+' (fine) up to ``good``, '0' between."""
    return "-" if value >= bad else "+" if value <= good else "0"


class _Kept(dict):
    """What has been computed of words and shapes; it starts anew when it holds 50,000."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= 50_000:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _word_facts(w: str) -> tuple[int, ...]:
    """Letters, symbols, capitals, and 1 for a word with symbols, in capitals, at the end of a sentence, and a bar."""
    symbols = len(_SYMBOL.findall(w))
    return (
        sum(map(len, _LETTERS.findall(w))),
        symbols,
        sum(map(str.isupper, w)),
        symbols > 0 and not w.isalnum(),
        len(w) > 1 and w.upper() == w and w.lower() != w,
        w[-1] in ".!?。…",
        w in _BARS,
    )


#: Marks that may end a plain word, the first four at the end of a sentence or not at all; and the shapes of plain words.
_TAILS = ("", ".", "!", "?", ",", ";", ":")
_TAIL_AT = {c: i for i, c in enumerate(_TAILS)}
_PLAIN_SHAPES = tuple(first + tail for first in ("a", "Aa") for tail in _TAILS)


def _plain(w: str) -> int:
    """Letters * 16 + place in _PLAIN_SHAPES of a lower-case or capitalised word of letters with one mark at most at its end; or -1."""
    last = w[-1]
    if last.isalpha():
        core, tail = w, 0
    else:
        core, tail = w[:-1], _TAIL_AT.get(last, -1)
    if tail < 0 or not core.isalpha() or not (core.isascii() or core.upper() != core):
        return -1
    if core.islower():
        return len(core) << 4 | tail
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return len(core) << 4 | tail + len(_TAILS)
    return -1


_BARS = frozenset("|·•»>")
_facts = _Kept(_word_facts)


def votes(text: str) -> str:
    """One character for each labeller: + fine, - poor, 0 no opinion. A text without words is poor to two of them."""
    words = text.split()
    n = len(words)
    if not n:
        return "000000-0-"
    counts = Counter(words)
    letters, symbols, capitals, symbol_words, shouted, ends, bars = (sum(x) for x in zip(*map(_facts.__getitem__, words)))
    letters = max(1, letters)
    cries = text.count("!!") + text.count("??")
    repeats = sum(map(str.__eq__, words, words[1:]))
    short = n < 20
    mean = letters / n
    return "".join(
        (
            _vote(symbols / letters, 0.08, 0.02),
            _vote(symbol_words / n, 0.2, 0.05),
            _vote(bars / n, 0.15, 0.03),
            _vote(capitals / letters, 0.4, 0.2),
            "0" if short else _vote(shouted / n, 0.35, 0.1),
            _vote(cries / n, 0.15, 0.03),
            "0" if n < 3 else _vote(repeats / (n - 1), 0.3, 0.08),
            "0" if short else _vote(1 - len(counts) / n, 0.85, 0.6) if n < 400 else "0",
            "-" if mean < 1.5 or mean > 25 else "+" if ends and mean >= 2.5 else "0",
        )
    )


LABELLERS = ("symbol characters", "symbol words", "bars", "capitals", "shouted words", "cries", "repeated neighbours", "few different words", "word shape")


@dataclass
class Labelling:
    """What EM found: prior of a fine document, and log-likelihoods [labeller, class, vote] of the votes + 0 -."""

    prior: float
    table: np.ndarray

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is fine."""
        at = ["+0-".index(c) for c in pattern]
        fine = np.log(self.prior) + sum(self.table[j, 1, v] for j, v in enumerate(at))
        poor = np.log(1 - self.prior) + sum(self.table[j, 0, v] for j, v in enumerate(at))
        return float(1 / (1 + np.exp(np.clip(poor - fine, -500, 500))))


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> Labelling:
    """Expectation-maximisation over the counts of vote patterns.

    A labeller's votes depend on the hidden class alone. It starts from the majority of votes, with any poor vote
    weighing more than a fine one, since most labellers know one kind of poor text each. Counts are smoothed.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes_of = np.array([["+0-".index(c) for c in k] for k in keys]).reshape(len(keys), len(LABELLERS))
    fine = np.where((votes_of == 2).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = float(np.clip((n @ fine + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4))
        table = np.zeros((len(LABELLERS), 2, 3))
        for c, weight in ((0, n * (1 - fine)), (1, n * fine)):
            for v in range(3):
                table[:, c, v] = 0.5 + weight @ (votes_of == v)
            table[:, c] /= table[:, c].sum(axis=1, keepdims=True)
        table = np.log(table)
        out = Labelling(prior, table)
        new = np.array([out.posterior(k) for k in keys])
        if len(new) == 0 or np.abs(new - fine).max() < 1e-9:
            break
        fine = new
    return out


_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Kinds of characters in order, runs as one: Thnd*** is Aa*."""
    plain = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word) if not word.isascii() else word.translate(_SHAPE)
    return _RUNS.sub(r"\1", plain)[:12]


_shapes = _Kept(shape)
_word_hash = _Kept(lambda w: xxhash.xxh3_64_intdigest("w" + w.lower()))
_shape_hash = _Kept(lambda s: xxhash.xxh3_64_intdigest("s" + s))
_pair_hash = _Kept(lambda p: xxhash.xxh3_64_intdigest(f"p{p[0]} {p[1]}"))
_REPEAT = xxhash.xxh3_64_intdigest("r")


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: words, their shapes, pairs of shapes, equal neighbours; counts damped, length 1.

    The top bit of a feature's hash is its sign. A bucket may come more than once.
    """
    words = text.split()
    n = max(1, len(words))
    own = [_shapes[w] for w in words]
    one, two, three = Counter(own), Counter(zip(own, own[1:])), Counter(words)
    hashes = [_REPEAT, *map(_shape_hash.__getitem__, one), *map(_pair_hash.__getitem__, two), *map(_word_hash.__getitem__, three)]
    repeats = sum(map(str.__eq__, words, words[1:]))
    count = np.array([repeats, *one.values(), *two.values(), *three.values()], np.float64)
    count[0] *= 8 / n
    count[1 : 1 + len(one)] *= 6 / n
    count[1 + len(one) : 1 + len(one) + len(two)] *= 4 / n
    count[1 + len(one) + len(two) :] = np.sqrt(count[1 + len(one) + len(two) :] / (n * max(1, len(three))))
    h = np.array(hashes, np.uint64)
    return (h % np.uint64(buckets)).astype(np.int32), np.where(h >> np.uint64(63), count, -count).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], buckets: int = BUCKETS, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft labels, by gradient steps over all rows (Adam, L2)."""
    w = np.zeros(buckets + 1)
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    # both classes weigh the same
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = y / share + (1 - y) / (1 - share)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at] * value, len(rows)) + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(at, e[row] * value, buckets), e.sum()) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Scorer:
    labelling: Labelling
    weights: np.ndarray

    def score(self, text: str) -> float:
        """Probability that a text is fine. A text without words has no features: the labellers' posterior stands."""
        if not text.strip():
            return self.labelling.posterior(votes(text))
        at, value = features(text, len(self.weights) - 1)
        z = float(self.weights[at] @ value + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Reader:
    """Votes and scores of many texts at once: facts of words are looked up once a word, all else is done on arrays.

    It finds what votes() and Scorer.score() find of each text. A worker keeps what it knows of MOST words; with more
    it forgets those that it has met once, or all.
    """

    MOST = 200_000
    #: Characters of texts that are taken together.
    CHUNK = 1 << 20

    def __init__(self, model: Scorer | None = None):
        self.model, self.posteriors = model, {}
        self._anew()

    def _anew(self) -> None:
        self.ids: dict[str, int] = {}
        self.shape_ids: dict[str, int] = {}
        self.shape_names: list[str] = []
        self.by_shape: list[float] = []
        self.pairs: dict[int, float] = {}
        self.facts, self.used = np.zeros((1024, 7), np.int32), np.zeros(1024, np.int64)
        self.shape_of, self.word_weight, self.shape_weight = np.zeros(1024, np.int64), np.zeros(1024), np.zeros(1024)

        for own in _PLAIN_SHAPES if self.model else ():
            self._shape(own)

    def _shape(self, own: str) -> None:
        if own not in self.shape_ids:
            self.shape_ids[own] = len(self.shape_names)
            self.shape_names.append(own)
            self.by_shape.append(self._weight(xxhash.xxh3_64_intdigest("s" + own)))

    def _weight(self, h: int) -> float:
        """A feature's weight with its sign."""
        w = float(self.model.weights[h % (len(self.model.weights) - 1)])
        return w if h >> 63 else -w

    def _forget(self) -> None:
        """Keeps the words met more than once, where these are at most half of MOST."""
        n = len(self.ids)
        keep = np.flatnonzero(self.used[:n] > 1)
        if len(keep) > self.MOST // 2 or len(self.pairs) > self.MOST:
            return self._anew()
        words = list(self.ids)
        self.ids = {words[i]: k for k, i in enumerate(keep.tolist())}
        for x in (self.facts, self.used, self.shape_of, self.word_weight, self.shape_weight):
            x[: len(keep)] = x[keep]
        self.used[:] = 0

    def _learn(self, words: list[str]) -> None:
        """Adds words that are not known yet."""
        first, n = len(self.ids), len(self.ids) + len(words)
        self.ids.update(zip(words, range(first, n)))
        while n > len(self.facts):
            self.facts, self.used, self.shape_of, self.word_weight, self.shape_weight = (np.concatenate([x, np.zeros_like(x)]) for x in (self.facts, self.used, self.shape_of, self.word_weight, self.shape_weight))
        plain = np.array(list(map(_plain, words)), np.int64)
        kind, odd = plain & 15, np.flatnonzero(plain < 0)
        self.facts[first:n] = 0
        self.facts[first:n, 0] = plain >> 4
        self.facts[first:n, 2] = kind >= len(_TAILS)
        self.facts[first:n, 5] = np.isin(kind % len(_TAILS), (1, 2, 3))
        if len(odd):
            self.facts[first + odd] = [_word_facts(words[i]) for i in odd.tolist()]
        if self.model:
            shapes = [shape(words[i]) for i in odd.tolist()]
            for own in dict.fromkeys(shapes):
                self._shape(own)
            at = np.minimum(kind, len(_PLAIN_SHAPES) - 1)
            at[odd] = [self.shape_ids[own] for own in shapes]
            self.shape_of[first:n], self.shape_weight[first:n] = at, np.array(self.by_shape)[at]
            h = np.array([xxhash.xxh3_64_intdigest("w" + w.lower()) for w in words], np.uint64)
            own = self.model.weights[(h % np.uint64(len(self.model.weights) - 1)).astype(np.int64)]
            self.word_weight[first:n] = np.where(h >> np.uint64(63), own, -own)

    def _pair_weights(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        codes, back = np.unique(first << 32 | second, return_inverse=True)
        out = []
        for c in codes.tolist():
            w = self.pairs.get(c)
            if w is None:
                w = self.pairs[c] = self._weight(xxhash.xxh3_64_intdigest(f"p{self.shape_names[c >> 32]} {self.shape_names[c & (1 << 32) - 1]}"))
            out.append(w)
        return np.array(out)[back]

    def read(self, texts: list[str]) -> dict[str, list]:
        """votes, and with a model weak and score, of each text."""
        out: dict[str, list] = {"votes": [], "weak": [], "score": []}
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= self.CHUNK):
                size += len(texts[high])
                high += 1
            for k, v in self._some(texts[low:high]).items():
                out[k] += v
            low = high
        return out

    def _some(self, texts: list[str]) -> dict[str, list]:
        if len(self.ids) > self.MOST:
            self._forget()
        split = [t.split() for t in texts]
        n = np.array([len(x) for x in split])
        words = [w for x in split for w in x]
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(ids < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            ids[new] = [self.ids[words[i]] for i in new]
        self.used[: len(self.ids)] += np.bincount(ids, minlength=len(self.ids))
        full = np.flatnonzero(n)
        sums, unlike, repeats = np.zeros((len(texts), 7)), np.zeros(len(texts)), np.zeros(len(texts))
        score = np.zeros(len(texts))
        if len(full):
            own = n[full]
            starts, doc = np.cumsum(own) - own, np.repeat(np.arange(len(full)), own)
            # one column at a time: no table of tokens and facts
            for j in range(7):
                sums[full, j] = np.add.reduceat(self.facts[ids, j], starts, dtype=np.int64)
            inner = np.ones(len(ids), bool)
            inner[starts] = False
            same = np.append(False, ids[1:] == ids[:-1]) & inner
            repeats[full] = np.add.reduceat(same, starts, dtype=np.int64)
            coded = np.sort(doc * np.int64(len(self.ids)) + ids)
            at = np.flatnonzero(np.append(True, coded[1:] != coded[:-1]))
            count, coded = np.diff(np.append(at, len(coded))), coded[at]
            of, word = coded // len(self.ids), coded % len(self.ids)
            unlike[full] = np.bincount(of, minlength=len(full))
            if self.model:
                z = np.bincount(of, self.word_weight[word] * np.sqrt(count), len(full)) / np.sqrt(own * unlike[full])
                z += 6 / own * np.bincount(doc, self.shape_weight[ids], len(full))
                shapes = self.shape_of[ids]
                pair = np.flatnonzero(inner)
                if len(pair):
                    z += 4 / own * np.bincount(doc[pair], self._pair_weights(shapes[pair - 1], shapes[pair]), len(full))
                z += 8 / own * repeats[full] * self._weight(_REPEAT) + self.model.weights[-1]
                # equal texts may stand beside other words: what the order of additions changes is rounded off
                score[full] = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
        found = self._votes(texts, n, sums, unlike, repeats)
        if not self.model:
            return {"votes": found}
        for v in set(found) - self.posteriors.keys():
            self.posteriors[v] = self.model.labelling.posterior(v)
        weak = [self.posteriors[v] for v in found]
        return {"votes": found, "weak": weak, "score": np.where(n > 0, score, weak).tolist()}

    @staticmethod
    def _votes(texts: list[str], n: np.ndarray, sums: np.ndarray, unlike: np.ndarray, repeats: np.ndarray) -> list[str]:
        letters, symbols, capitals, symbol_words, shouted, ends, bars = sums.T
        cries = np.array([t.count("!!") + t.count("??") for t in texts])
        any_letters, some = np.maximum(letters, 1), np.maximum(n, 1)
        mean = any_letters / some
        none, short = n == 0, n < 20

        def vote(value: np.ndarray, bad: float, good: float, silent: np.ndarray | bool = False) -> np.ndarray:
            return np.select([silent, value >= bad, value <= good], [48, 45, 43], 48)

        rows = np.stack(
            [
                vote(symbols / any_letters, 0.08, 0.02, none),
                vote(symbol_words / some, 0.2, 0.05, none),
                vote(bars / some, 0.15, 0.03, none),
                vote(capitals / any_letters, 0.4, 0.2, none),
                vote(shouted / some, 0.35, 0.1, short),
                vote(cries / some, 0.15, 0.03, none),
                np.where(none, 45, vote(repeats / np.maximum(n - 1, 1), 0.3, 0.08, n < 3)),
                vote(1 - unlike / some, 0.85, 0.6, short | (n >= 400)),
                np.where(none | (mean < 1.5) | (mean > 25), 45, np.where((ends > 0) & (mean >= 2.5), 43, 48)),
            ],
            axis=1,
        ).astype(np.uint8)
        return [r.tobytes().decode() for r in rows]


def _decoded(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


_readers: dict[str, Reader] = {}


def _reader(name: str, model: Callable[[], Scorer] | None = None) -> Reader:
    """The worker's reader of that name, which outlives a task; it holds one."""
    if name not in _readers:
        _readers.clear()
        _readers[name] = Reader(model() if model else None)
    return _readers[name]


def text_votes(docs: DataFrame) -> DataFrame:
    """doc_id, th, votes of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), **_reader("votes").read(_decoded(batch.column("text")))}

    return by_batch(_slim(Veil(docs)), work, "doc_id long, th long, votes string")


def _slim(veil: Veil) -> DataFrame:
    t = veil.col("text")
    return veil.df.select(veil.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t, t.isNull()).alias("th"), t.cast("binary").alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Votes of all documents make the labelling; at most ``sample`` different ones, least by a hash of id and text, train the scorer.

    Patterns of votes are few (three votes a labeller), so their counts over the whole table fit the driver. Features
    are built on the executors; only those of the sample reach the driver.
    """
    found = saved(text_votes(docs), "votes")
    patterns = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labelling = estimate(patterns)
    # a poor text is rare: half of the sample is of either side
    key = F.xxhash64("doc_id", "th", F.lit(SEED))
    poor = [k for k in patterns if labelling.posterior(k) < 0.5]
    n_poor = sum(patterns[k] for k in poor)
    picked = []
    for c, n in ((F.col("votes").isin(poor), n_poor), (~F.col("votes").isin(poor), sum(patterns.values()) - n_poor)):
        # few enough come by their hashes to be sorted; a text that is repeated is in it once
        few = found.where(c).where(least_share(key, sample / max(1, n))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), "votes", key.alias("k")).distinct()
        picked.append(few.orderBy("k", "_d", "_th").limit(sample // 2))
    picked = picked[0].unionByName(picked[1])
    marked = _slim(Veil(docs))
    rows = marked.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th"))).select("votes", "text", "k")
    seen: set[int] = set()

    def work(batch: pa.RecordBatch) -> dict:
        new = [i for i, k in enumerate(batch.column("k").to_pylist()) if not (k in seen or seen.add(k))]
        batch = batch.take(pa.array(new, pa.int64()))
        own = [features(t) for t in _decoded(batch.column("text"))]
        return {"k": batch.column("k"), "votes": batch.column("votes"), "at": [x.tolist() for x, _ in own], "value": [x.tolist() for _, x in own]}

    # copies of a text go no further than the task that reads them
    got = by_batch(rows, work, "k long, votes string, at array<int>, value array<float>").dropDuplicates(["k"]).toArrow()
    order = np.argsort(got.column("k").to_numpy(), kind="stable")
    patterns, at, value = (got.column(c).combine_chunks() for c in ("votes", "at", "value"))
    train_rows = [(at[i].values.to_numpy(), value[i].values.to_numpy(), labelling.posterior(patterns[i].as_py())) for i in order.tolist()]
    return Scorer(labelling, train(train_rows))


ADDED = ("votes", "weak", "score", "keep")


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """docs with votes, weak (the labellers' posterior), score (the scorer's probability of a fine text) and keep (score of 0.5)."""
    held, veil = docs.sparkSession.sparkContext.broadcast(model), Veil(docs)
    fields = veil.fields(*ADDED)
    names = list(fields.names)
    rows, text, texts_of = text_once(veil)
    call = uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> dict:
        out = _reader(call, lambda: held.value).read(texts_of(batch))
        return {k: batch.column(k) for k in names} | out | {"keep": [x >= 0.5 for x in out["score"]]}

    for name, kind in zip(ADDED, (StringType(), DoubleType(), DoubleType(), BooleanType())):
        fields = fields.add(name, kind)
    return veil.back(by_batch(rows.select(*dict.fromkeys([*names, text])), work, fields), ADDED)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with votes, weak, score and keep.

    Null text counts as empty; empty and blank texts get the labellers' posterior as their score. Equal texts have
    equal scores, so ties and repeated rows don't matter. Columns of docs named like the added ones are replaced; all
    others are passed on. An empty table is returned empty.
    """
    return scored(docs, fit(docs, sample))
