"""Exact, cached encoding with the tokenizers library.

Both vocabularies split a text at white space before merging, so the ids of a text are those of its words in a row (a
byte-level word with the one space or line break before it), and those of a word are the ids of what stands before its
closing punctuation and of the punctuation. The words of many texts are found and hashed at once; each distinct one is
encoded by the library once and its ids are kept in arrays. A text that holds an added token of the vocabulary, or whose white space is not
the plain kind, is given to the library whole. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

from .shingles import mix, word_hashes, word_spans

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

#: Words and ids that one Python worker keeps (about 30 bytes a word), words not yet merged with the others, and the longest word kept.
MAX_WORDS, MAX_IDS, MAX_RECENT, MAX_WORD_BYTES = 1_500_000, 12_000_000, 60_000, 64
#: Texts are handled together up to so many characters, and longer ones are cut at single spaces.
TOGETHER, LONGEST = 1_000_000, 8_000_000
_EDGES = re.compile(r"[^\s\x1c-\x1f\x85](?:.*[^\s\x1c-\x1f\x85])?", re.S)
_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
#: A letter or digit that stays one character in lower case, then punctuation to the end: always two tokens. An apostrophe may belong to letters after it.
_CLOSED = re.compile(rb"(.*(?:[A-Za-z0-9]|\xc3[\xa0-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)", re.S)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_OPEN = frozenset(range(48, 58)) | frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))


def _keys(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of words with the byte that is merged with them (0: none)."""
    return mix(hashes + before.astype(np.uint64))


def _take(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of flat, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Words:
    """Ids of words by key: sorted keys with the place of their ids, which stand one after another in the order learned."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.kept = self.recent = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids begin (-1: not known) and how many they are."""
        begin, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for names, begins, sizes in (self.kept, self.recent):
            if len(names) and len(left):
                at = np.minimum(np.searchsorted(names, keys[left]), len(names) - 1)
                hit = names[at] == keys[left]
                begin[left[hit]], size[left[hit]] = begins[at[hit]], sizes[at[hit]]
                left = left[~hit]
        return begin, size

    def put(self, ids: np.ndarray) -> int:
        """Where ids that are added begin."""
        at = self.used
        self.used += len(ids)
        if self.used > len(self.ids):
            more = np.zeros(self.used + self.used // 2, np.uint32)
            more[:at] = self.ids[:at]
            self.ids = more
        self.ids[at : self.used] = ids
        return at

    def name(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Give keys that are not known, each once and in ascending order, to ids that were added."""
        at = np.searchsorted(self.recent[0], keys)
        self.recent = tuple(np.insert(old, at, new.astype(old.dtype)) for old, new in zip(self.recent, (keys, begin, size)))
        if len(self.recent[0]) > MAX_RECENT:
            at = np.searchsorted(self.kept[0], self.recent[0])
            self.kept = tuple(np.insert(old, at, new) for old, new in zip(self.kept, self.recent))
            self.recent = tuple(x[:0] for x in self.recent)

    def trim(self) -> None:
        """If there are too many, the half that was learned first stays: frequent words come early."""
        if len(self.kept[0]) > MAX_WORDS or self.used > MAX_IDS:
            self.used = min(self.used, MAX_IDS) // 2 if self.used > MAX_IDS else int(np.median(self.kept[1]))
            self.kept, self.recent = (tuple(x[t[1].astype(np.int64) + t[2] <= self.used] for x in t) for t in (self.kept, self.recent))
            self.ids = self.ids[: self.used].copy()


class PieceEncoder:
    """spaced: a space belongs to the word after it (byte-level BPE); else white space is dropped."""

    def __init__(self, tokenizer_json: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spaced, self.words = spaced, Words()
        self.lowers = '"type":"Lowercase"' in json.dumps(json.loads(tokenizer_json).get("normalizer"), separators=(",", ":"))
        added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added))).encode(), re.I) if added else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words begin and how many they are; -1 for a word whose ids depend on what is around it.

        A word begins with the byte that is merged with it, if there is one. What a word and its closing punctuation are
        is looked up apart, in small letters if that is no difference.
        """
        parts: dict[bytes, int] = {}
        first, second = [], []
        for w in words:
            m = None if w[-1] in _OPEN else _CLOSED.fullmatch(w)
            core, tail = m.groups() if m else (w, None)
            if self.lowers:
                core = core.lower()
            first.append(parts.setdefault(core, len(parts)))
            second.append(-1 if tail is None else parts.setdefault(tail, len(parts)))
        listed = list(parts)
        names = word_hashes(b"\n".join(listed))[0]
        if self.spaced:
            heads = np.fromiter((w[0] for w in listed), np.int64, len(listed))
            names = _keys(names, np.where(_WHITE[heads], heads, 0))
        begin, size = self.words.find(names)
        new = np.flatnonzero(begin < 0)
        texts = [listed[i].decode() for i in new.tolist()]
        if self.spaced:
            fine = np.fromiter((_EDGES.fullmatch(t, t[0] in "\t\n\x0b\x0c\r ") is not None for t in texts), bool, len(texts))
            new, texts = new[fine], [t for t, good in zip(texts, fine.tolist()) if good]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size[new] = np.fromiter(map(len, found), np.int64, len(found))
        begin[new] = self.words.put(np.fromiter(chain.from_iterable(found), np.uint32)) + np.cumsum(size[new]) - size[new]
        a, b = np.array(first), np.array(second)
        two = b >= 0
        known = (begin[a] >= 0) & (~two | (begin[b] >= 0))
        pairs = np.stack([a, b], 1)
        sizes = np.where(known[:, None] & (pairs >= 0), size[pairs], 0)
        total = sizes.sum(1)
        starts = begin[a].copy()
        starts[two] = self.words.put(_take(self.words.ids, begin[pairs[two]].ravel(), sizes[two].ravel())) + np.cumsum(total[two]) - total[two]
        starts[~known] = -1
        # Of a word and a part that are the same, one is named.
        lengths = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, listed), np.int64, len(listed))[new]
        named, at = np.unique(np.concatenate([keys, names[new]]), return_index=True)
        begins, counts = np.concatenate([starts, begin[new]])[at], np.concatenate([total, size[new]])[at]
        keep = (np.concatenate(lengths)[at] <= MAX_WORD_BYTES) & (begins >= 0) & (counts < 256)
        self.words.name(named[keep], begins[keep], counts[keep])
        return starts, total

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > TOGETHER or i + 1 == len(texts):
                out += self._some(texts[at : i + 1]) if size <= LONGEST + TOGETHER else [b"".join(self._some([p])[0] for p in self._cuts(t)) for t in texts[at : i + 1]]
                at, size = i + 1, 0
        return out

    @staticmethod
    def _cuts(text: str):
        at = 0
        while len(text) - at > LONGEST and (m := _CUT.search(text, at + LONGEST)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _some(self, texts: list[str]) -> list[bytes]:
        data = [t.encode() for t in texts]
        joined = b"\n".join(data)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        text_ends = np.cumsum(sizes + 1) - 1
        key, starts, ends = word_spans(joined)
        owner = np.searchsorted(text_ends, starts, "right")
        slow = np.fromiter((self.added is not None and self.added.search(x) is not None for x in data), bool, len(data))
        lead = np.zeros(len(key), np.int64)  # bytes before the word that are merged with it
        if self.spaced and len(key):
            b = np.frombuffer(joined, np.uint8)
            begins = (text_ends - sizes)[owner]
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            gap = starts - np.where(first, begins, np.concatenate([[0], ends[:-1]]))
            before = b[np.maximum(starts - 1, 0)]
            lead = (gap > 0).astype(np.int64)
            plain = (gap == 0) & first | (gap == 1) & ((before == 32) | (before == 10))
            slow[owner[~plain]] = True
            last = np.concatenate([first[1:], [True]])
            slow[owner[last & (ends < text_ends[owner])]] = True
            key = _keys(key, lead.astype(np.uint64) * before)
        if self.spaced:
            slow[(sizes > 0) & (np.bincount(owner, minlength=len(texts)) == 0)] = True
        distinct, at, of = np.unique(key, return_index=True, return_inverse=True)
        begin, size = self.words.find(distinct)
        missing = np.flatnonzero(begin < 0)
        if len(missing):
            own = at[missing]
            words = [joined[a:z] for a, z in zip((starts[own] - lead[own]).tolist(), ends[own].tolist())]
            begin[missing], size[missing] = self._learn(distinct[missing], words)
            unclear = begin < 0
            if unclear.any():
                slow[owner[unclear[of]]] = True
        begin, size = begin[of], size[of]
        upto = np.concatenate([[0], np.cumsum(size)])
        stream = _take(self.words.ids, begin, size)
        self.words.trim()
        cuts = upto[np.searchsorted(owner, np.arange(len(texts) + 1))].tolist()
        view = stream.tobytes()
        out = [view[4 * a : 4 * z] for a, z in zip(cuts[:-1], cuts[1:])]
        whole = np.flatnonzero(slow).tolist()
        for i, v in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = v
        return out


_ENCODERS: dict[tuple[int, bool], PieceEncoder] = {}


def encoder_for(tokenizer_json: str, spaced: bool) -> PieceEncoder:
    """One encoder for each Python worker; tasks that reuse the worker find its words."""
    key = (hash(tokenizer_json), spaced)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_json, spaced)
    return _ENCODERS[key]
