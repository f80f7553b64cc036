"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes that are not ASCII white space. A word's hash is a polynomial over its bytes modulo 2^64, taken
from running sums over a block of text; a shingle's combines the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for b in (_BASE, _INVERSE):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the start and the end of each word."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word."""
    return word_spans(data)[:2]


def _blocks(data: bytes):
    """Pieces of about BLOCK bytes, cut at white space (a longer word stays whole)."""
    at = 0
    while at < len(data):
        stop = at + BLOCK
        while stop < len(data) and data[stop] not in b"\t\n\x0b\x0c\r ":
            stop += 1
        yield data[at:stop]
        at = stop


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the text that each is from."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, owners = [], []
    group: list[int] = []
    size = 0

    def close():
        if group:
            ends = np.cumsum([len(data[i]) + 1 for i in group])
            h, starts = word_hashes(b"\n".join(data[i] for i in group))
            hashes.append(h)
            owners.append(np.array(group, np.int64)[np.searchsorted(ends, starts, "right")])
            group.clear()

    for i, x in enumerate(data):
        if len(x) > BLOCK:
            close()
            size = 0
            for part in _blocks(x):
                h, _ = word_hashes(part)
                hashes.append(h)
                owners.append(np.full(len(h), i, np.int64))
            continue
        if size + len(x) > BLOCK:
            close()
            size = 0
        group.append(i)
        size += len(x) + 1
    close()
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles_of(words: np.ndarray, owners: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the text of each. A text of 1 to n - 1 words has one: all its words."""
    factor = np.uint64(0xD6E8FEB86659FD93)
    if len(words) >= n:
        code = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            code = code * factor + words[k : len(words) - n + 1 + k]
        whole = owners[: len(code)] == owners[n - 1 :]
        code, own = mix(code[whole]), owners[: len(whole)][whole]
    else:
        code, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids, firsts, counts = np.unique(owners, return_index=True, return_counts=True)
    extra, extra_own = [], []
    for i, at, c in zip(ids[counts < n].tolist(), firsts[counts < n].tolist(), counts[counts < n].tolist()):
        h = c
        for w in words[at : at + c].tolist():
            h = (h * int(factor) + w) & 0xFFFFFFFFFFFFFFFF
        extra.append(h)
        extra_own.append(i)
    if extra:
        code, own = np.concatenate([code, mix(np.array(extra, np.uint64))]), np.concatenate([own, np.array(extra_own, np.int64)])
    return code, own


def weighted(code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles and how often it has them: (code, text, weight)."""
    order = np.lexsort((code, own))
    code, own = code[order], own[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return code[at], own[at], np.diff(np.append(at, len(code)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted codes, weights)."""
    (ca, wa), (cb, wb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(ca):
        return 0.0
    at = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
    same = cb[at] == ca
    both = int(np.minimum(wa[same], wb[at[same]]).sum())
    return both / (int(wa.sum()) + int(wb.sum()) - both)
