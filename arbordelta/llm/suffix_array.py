"""Two-stage suffix sorting of many short strings, vectorised, to a fixed depth.

Strings are joined with the end mark 0 and byte values raised by 1. Stage one sorts directly only the suffixes that are
smaller than their successors (S). Stage two scans the buckets of first characters in ascending order: a suffix larger
than its successor (L) goes to the next free place of its bucket when its successor is met. A suffix whose successor is
in order to depth d is in order to d + 1, so sorting the S suffixes to `depth` is enough for all.
"""

from __future__ import annotations

import numpy as np

#: Characters (9 bits each) in a sorting key.
CHARS = 7


def join(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Characters of the strings (bytes one after another), each string followed by 0."""
    ends = np.cumsum(lengths)
    out = np.zeros(len(strings) + len(lengths), np.uint16)
    out[np.arange(len(strings)) + np.repeat(np.arange(len(lengths)), lengths)] = strings.astype(np.uint16) + 1
    assert len(ends) == 0 or ends[-1] == len(strings)
    return out


def remaining(t: np.ndarray) -> np.ndarray:
    """Characters from each place to the next end mark."""
    places = np.where(t == 0, np.arange(len(t)), len(t))
    return np.minimum.accumulate(places[::-1])[::-1] - np.arange(len(t))


def keys(t: np.ndarray) -> np.ndarray:
    """The CHARS characters at each place as one number; nothing after an end mark counts."""
    padded = np.concatenate([t, np.zeros(CHARS, np.uint16)]).astype(np.uint64)
    out, alive = np.zeros(len(t), np.uint64), np.ones(len(t), bool)
    for k in range(CHARS):
        c = padded[k : k + len(t)]
        alive &= c > 0
        out = (out << np.uint64(9)) | np.where(alive, c, np.uint64(0))
    return out


def is_smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; a run of one character follows its end."""
    n = len(t)
    out = np.zeros(n, bool)
    if n > 1:
        changes = np.flatnonzero(t[1:] != t[:-1])
        at = np.searchsorted(changes, np.arange(n - 1))
        last = changes[np.minimum(at, max(len(changes) - 1, 0))] if len(changes) else np.zeros(n - 1, np.int64)
        known = at < len(changes)
        out[:-1] = known & (t[last] < t[np.minimum(last + 1, n - 1)])
    return out


def _sort_direct(places: np.ndarray, key: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """places ordered by their suffixes to `depth` at least: ties are refined by the next key, CHARS at a time."""
    order = places[np.argsort(key[places], kind="stable")]
    k = key[order]
    group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    for at in range(CHARS, depth, CHARS):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(group) > 1 else np.zeros(0, np.int64)
        if not len(tied):
            break
        p = order[tied]
        nxt = np.where(left[p] > at, key[np.minimum(p + at, len(key) - 1)], np.uint64(0))
        by = np.lexsort((nxt, group[tied]))
        order[tied], nxt, g = p[by], nxt[by], group[tied]
        new = np.zeros(len(group), np.int64)
        new[tied[1:]] = (nxt[1:] != nxt[:-1]) & (g[1:] == g[:-1])
        group = np.cumsum(new + np.concatenate([[0], group[1:] != group[:-1]]))
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of t in the order of their suffixes, exact to `depth` characters. t ends with an end mark."""
    smaller, key, left = is_smaller(t), keys(t), remaining(t)
    larger = ~smaller & (t > 0)
    direct = _sort_direct(np.flatnonzero(smaller & (t > 0)), key, left, depth)
    cuts = np.searchsorted(t[direct], np.arange(258))
    incoming: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero(t == 0)
        else:
            parts = [np.concatenate(incoming[c])] if incoming[c] else []
            while parts and len(parts[-1]):
                p = parts[-1] - 1
                p = p[p >= 0]
                parts.append(p[larger[p] & (t[p] == c)])
            bucket = np.concatenate([*parts, direct[cuts[c] : cuts[c + 1]]])
        incoming[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[larger[p] & (t[p] > c)]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            chars, starts = np.unique(t[p], return_index=True)
            for ch, part in zip(chars.tolist(), np.split(p, starts[1:])):
                incoming[ch].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each entry of order but the first, the length (at most `most`) of the prefix that it shares with the one before."""
    a, b = order[:-1], order[1:]
    out, going = np.zeros(len(a), np.int64), np.arange(len(a))
    padded = np.concatenate([t, np.zeros(most + 1, t.dtype)])
    for k in range(most):
        x, y = padded[a[going] + k], padded[b[going] + k]
        going = going[(x == y) & (x > 0)]
        if not len(going):
            break
        out[going] = k + 1
    return out
