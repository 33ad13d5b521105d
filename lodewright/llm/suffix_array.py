"""Two-stage suffix sorting of a byte string, to a fixed depth."""

from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the one that starts a byte later; the end counts as smallest."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # last place of each run but the final one
    out = np.zeros(n, bool)
    if len(change):
        run = np.searchsorted(change, np.arange(change[-1] + 1))
        out[: change[-1] + 1] = (t[1:] > t[:-1])[change][run]
    return out


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` bytes at least.

    Two stages: suffixes smaller than their successor are sorted directly, by comparing up to ``depth`` bytes. All
    others are induced by one scan over the 256 buckets in order: the suffix before one that has its place, if it
    begins with a byte no smaller, is the next in its bucket. Suffixes equal to that depth stand together in any order.
    """
    t = np.frombuffer(text, np.uint8)
    if not len(t):
        return np.zeros(0, np.int64)
    small = smaller_than_next(t)
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i : i + depth]), np.int64)
    heads = np.searchsorted(t[direct], np.arange(257))  # direct is ordered by first byte
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([len(t) - 1]))  # before the end, which is smallest
    out = []
    for c in range(256):
        induced = []
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(wave):  # within a bucket, a run of one byte is induced step by step
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        own = np.concatenate([*induced, direct[heads[c] : heads[c + 1]]])
        waiting[c] = []
        if not len(own):
            continue
        out.append(own)
        before = own[own > 0] - 1
        before = before[t[before] > c]
        if len(before):
            to = t[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            for piece, b in zip(np.split(before, cuts), to[np.concatenate([[0], cuts])]):
                waiting[b].append(piece)
    return np.concatenate(out)


def adjacent_common(text: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair in the suffix array whether their common prefix has ``length`` bytes or more.

    Words of 8 bytes are compared from the start on, for the pairs that are still equal.
    """
    padded = np.frombuffer(text + bytes(length + 8), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    same = np.flatnonzero((order[1:] + length <= len(text)) & (order[:-1] + length <= len(text)))
    at = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for d in at:
        same = same[words[order[same] + d] == words[order[same + 1] + d]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[same] = True
    return out
