"""Licence families of paragraphs: a sparse word n-gram classifier with a calibrated unknown class, confirmed by templates."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, text_hash
from .license_templates import NEGATIVES, TEMPLATES

UNKNOWN = "unknown"
GRAMS = 3
#: Documents whose paragraphs are examples of the unknown class at most, and paragraphs of each that are used.
SAMPLE, OF_EACH = 400, 4
#: Words of a passage at most; longer paragraphs are cut into windows that overlap by half.
WINDOW = 120
#: Least calibrated probability of a family, and least share of a template's word pairs that the passage must hold.
CERTAIN, CONFIRMED = 0.5, 0.7
STEPS, COPIES, SEED = 150, 12, 3

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> list[str]:
    """Different n-grams of 1 to GRAMS words, with marks for both ends of a passage."""
    padded = ["^", *words, "$"]
    return list(dict.fromkeys([*words, *(" ".join(padded[i : i + n]) for n in range(2, GRAMS + 1) for i in range(len(padded) - n + 1))]))


def passages(text: str) -> list[tuple[int, int]]:
    """(start, end) code points of what is classified: each line, each paragraph of several lines, windows of long ones.

    Lines are split at line feeds and paragraphs at blank lines. Every word is in a passage.
    """
    out, low, lines = [], 0, []

    def windows(start: int, end: int) -> None:
        at = [m.start() for m in _WORD.finditer(text, start, end)]
        if len(at) <= WINDOW:
            if at:
                out.append((start, end))
            return
        for i in range(0, len(at) - WINDOW // 2, WINDOW // 2):
            out.append((at[i] if i else start, end if i + WINDOW >= len(at) else at[i + WINDOW]))

    def paragraph() -> None:
        if len(lines) > 1:
            windows(lines[0][0], lines[-1][1])
        for a, b in lines:
            windows(a, b)
        lines.clear()

    for line in text.split("\n"):
        if line.strip():
            lines.append((low, low + len(line)))
        else:
            paragraph()
        low += len(line) + 1
    paragraph()
    return out


@dataclass
class Model:
    """Softmax over families and the unknown class; scores are divided by a temperature fitted on held-out passages."""

    families: list[str]
    index: dict[str, int]
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float
    pairs: list[tuple[str, frozenset, Counter]]  # family, word pairs and words of each template

    def __post_init__(self) -> None:
        self.every = frozenset().union(*(pairs for _, pairs, _ in self.pairs))

    def confirmable(self, words: list[str]) -> bool:
        """Whether the words hold CONFIRMED of the word pairs of some template, without which confirmed() is less."""
        own = self.every.intersection(zip(words, words[1:]))
        return bool(own) and any(pairs and len(pairs & own) / len(pairs) >= CONFIRMED for _, pairs, _ in self.pairs)

    def probabilities(self, words: list[str]) -> np.ndarray:
        ids = [i for i in map(self.index.get, grams_of(words)) if i is not None]
        z = self.bias + (self.weights[ids].sum(axis=0) / max(1.0, len(ids)) ** 0.5 if ids else 0.0)
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    def confirmed(self, words: list[str], family: str) -> float:
        """The largest share of a template of the family whose word pairs the passage holds, in its own multiplicity of words."""
        own, got = set(zip(words, words[1:])), Counter(words)
        best = 0.0
        for name, pairs, counts in self.pairs:
            if name == family and pairs:
                share = len(pairs & own) / len(pairs)
                best = max(best, min(share, sum((counts & got).values()) / counts.total()))
        return best

    def of(self, words: list[str]) -> tuple[str, float, float]:
        """(family, probability, template share); unknown if improbable or not confirmed."""
        p = self.probabilities(words)
        k = int(p.argmax())
        if self.families[k] == UNKNOWN or p[k] < CERTAIN:
            return UNKNOWN, float(p[0]), 0.0
        share = self.confirmed(words, self.families[k])
        return (self.families[k] if share >= CONFIRMED else UNKNOWN), float(p[k]), share

    def findings(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of the passages with a licence, the smallest ones where they overlap."""
        found = []
        # neighbours in a passage are neighbours in the text
        if not self.confirmable(words_of(text)):
            return found
        for low, high in passages(text):
            words = words_of(text[low:high])
            if self.confirmable(words):
                family, p, _ = self.of(words)
                if family != UNKNOWN:
                    found.append((low, high, family, p))
        found.sort(key=lambda x: (x[1] - x[0], x[0]))
        out, taken = [], []
        for low, high, family, p in found:
            if not any(a < high and low < b for a, b in taken):
                out.append((low, high, family, p))
                taken.append((low, high))
        return sorted(out)


def _varied(words: list[str], filler: list[str], rng: random.Random) -> list[str]:
    """A copy with a few words lost or changed, or with other words before and after it."""
    rate = rng.choice((0.0, 0.03, 0.08))
    out = [rng.choice(filler) if rng.random() < rate / 2 else w for w in words if rng.random() > rate / 2]
    if rng.random() < 0.4:
        out = [rng.choice(filler) for _ in range(rng.randrange(6))] + out + [rng.choice(filler) for _ in range(rng.randrange(6))]
    return out or words


def train(unknown: list[list[str]], steps: int = STEPS, seed: int = SEED) -> Model:
    """Trains on varied copies of the templates and on passages of the unknown class; a fifth of them set the temperature."""
    rng = random.Random(seed)
    families = [UNKNOWN, *TEMPLATES]
    originals = [(f, words_of(t)) for f, ts in TEMPLATES.items() for t in ts]
    negatives = [words_of(t) for t in NEGATIVES]
    # an ordinary passage that shares a template's pairs isn't an example of the unknown
    pairs = [(f, frozenset(zip(w, w[1:])), Counter(w)) for f, w in originals]
    every = set().union(*(p for _, p, _ in pairs))
    unknown = [p for p in unknown if len(set(zip(p, p[1:])) & every) < 2]
    seen = Counter(w for p in unknown for w in set(p))
    filler = sorted(seen) or sorted({w for p in negatives for w in p})
    rows = [(families.index(f), _varied(w, filler, rng)) for f, w in originals for _ in range(COPIES)]
    rows += [(0, _varied(p, filler, rng)) for p in negatives for _ in range(COPIES // 2)] + [(0, p) for p in unknown]
    # pieces of templates by themselves, and the words of templates in another order, tell no licence
    for _, w in originals:
        if len(w) >= 6:
            rows += [(0, rng.sample(w, len(w))) for _ in range(4)] + [(0, w[a : a + 3]) for a in (rng.randrange(len(w) - 2) for _ in range(2))]
    rng.shuffle(rows)
    cut = len(rows) // 5
    held, rows = rows[:cut], rows[cut:]
    counts = Counter(g for _, w in rows for g in grams_of(w))
    index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n > 1))}
    lists = [[i for i in map(index.get, grams_of(w)) if i is not None] for _, w in rows]
    at = np.array([i for x in lists for i in x], np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value = np.repeat([max(1.0, len(x)) ** -0.5 for x in lists], [len(x) for x in lists])
    y = np.array([k for k, _ in rows])
    share = np.bincount(y, minlength=len(families)).astype(float)
    weight = (len(rows) / len(families) / np.maximum(share, 1.0))[y]
    w, b = np.zeros((len(index), len(families))), np.zeros(len(families))
    m, v = np.zeros((len(index) + 1, len(families))), np.zeros((len(index) + 1, len(families)))
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    rows_at = np.flatnonzero([bool(x) for x in lists])
    starts = np.cumsum([0, *map(len, lists)])[:-1][rows_at]
    for t in range(1, steps + 1):
        z = np.tile(b, (len(lists), 1))
        z[rows_at] += np.add.reduceat(w[at] * value[:, None], starts, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(y)), y] -= 1
        e *= weight[:, None] / len(rows)
        g = np.zeros_like(m)
        g[at[order][first]] = np.add.reduceat((e[row] * value[:, None])[order], first, axis=0)
        g[:-1] += 2e-5 * w
        g[-1] = e.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    model = Model(families, index, w.astype(np.float32), b, 1.0, pairs)
    model.temperature = _temperature(model, held)
    return model


def _temperature(model: Model, held: list[tuple[int, list[str]]]) -> float:
    """The temperature that makes the held-out passages most likely."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 31):
        model.temperature = float(t)
        loss = -sum(float(np.log(max(1e-12, model.probabilities(w)[k]))) for k, w in held)
        best = min(best, (loss, float(t)))
    return best[1]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains with passages of at most ``sample`` documents, the least by a hash of id and text, as the unknown class."""
    key = F.xxhash64("doc_id", text_hash(), F.lit(SEED))
    picked = docs.select(key.alias("k")).distinct().orderBy("k").limit(sample)
    rows = docs.select(key.alias("k"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "k", "left_semi").dropDuplicates(["k"])

    def some(batch: pa.RecordBatch) -> dict:
        out = {"k": [], "words": []}
        for k, raw in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
            text = (raw or b"").decode("utf-8", "replace")
            own = passages(text)
            for a, b in random.Random(k).sample(own, min(OF_EACH, len(own))):
                out["k"].append(k)
                out["words"].append(" ".join(words_of(text[a:b])))
        return out

    return train([r["words"].split() for r in by_batch(rows, some, "k long, words string").orderBy("k", "words").collect()])


def scan(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, families (different ones in order), n_passages, spans (family:start:end, code points), probability.

    Every passage of every whole text is classified. A family counts if its calibrated probability is CERTAIN or more
    and one of its templates has CONFIRMED of its word pairs and words in the passage. Null, empty and ordinary texts
    have none, and probability 0. Repeated rows are scanned as they come. Passages that hold too few word pairs of every
    template can't be confirmed and aren't scored. Columns other than doc_id and text are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, sample))

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("families", "n_passages", "spans", "probability")}
        for raw in batch.column("text").to_pylist():
            found = held.value.findings((raw or b"").decode("utf-8", "replace"))
            row = (",".join(sorted({f for _, _, f, _ in found})), len(found), ",".join(f"{f}:{a}:{b}" for a, b, f, _ in found), max((p for *_, p in found), default=0.0))
            for k, v in zip(out, row):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return by_batch(cut, work, "doc_id long, families string, n_passages long, spans string, probability double")
