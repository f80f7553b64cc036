"""Language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are hashed byte n-grams (1 to 4) of the lower-cased text, log-scaled and brought to length 1. The family is the
best of one-versus-rest machines over families; inside a family of k languages, k (k - 1) / 2 machines vote
and summed margins break ties. All machines are fitted on the driver from a bounded sample by dual coordinate descent;
prediction reads the text alone.

Bounds: no more than `per_language` distinct labelled texts of each language and `at_most` in all, those of least hash, are
learned from, but FEWEST of each language in any case, so every language is learned and the sample has at most
max(at_most, FEWEST x languages) rows; the model has dims x (families + pairs) numbers and is broadcast.

Defined cases: null text, or text without a letter, is `und` with score 0; rows without a language are not learned
from; with no labelled row everything is `und`; repeated rows are predicted alike; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map

DIMS, GRAMS = 4096, (1, 2, 3, 4)
# Families of common languages by code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), f"alone:{lang}")


def features(texts: list[str]) -> np.ndarray:
    """A row of DIMS float32 for each text."""
    data = [x.lower().encode("utf-8", "replace") for x in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    out = np.zeros((len(data), DIMS), np.float32)
    if not sizes.sum():
        return out
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(data), dtype=np.int64), sizes)
    counts = np.zeros(len(data) * DIMS)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(b):
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            inside = row[: len(code)] == row[n - 1 :]  # a gram doesn't run into the next text
            slot = ((code * np.uint32(2654435769) + np.uint32(n * 40503)) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount((row[: len(code)] * DIMS + slot)[inside], minlength=len(counts))
    out[:] = np.log1p(counts).reshape(out.shape)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    q = (x * x).sum(1) + 1 / (2 * c)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + a[i] / (2 * c)
            new = max(a[i] - g / q[i], 0.0)
            if step := new - a[i]:
                w += step * y[i] * x[i]
                most, a[i] = max(most, abs(step)), new
        if most < 1e-3:
            break
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs], np.int64)
        self.families = sorted({family(v) for v in self.langs})
        self.of = np.array([self.families.index(family(v)) for v in self.langs], np.int64)
        self.members = [np.flatnonzero(self.of == f) for f in range(len(self.families))]
        rest = [fit_svm(x, np.where(self.of[y] == f, 1.0, -1.0)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.family_w = np.array(rest, np.float32).reshape(len(rest), DIMS + 1)
        self.pairs = [p for m in self.members for p in combinations(m.tolist(), 2)]
        ones = []
        for a, b in self.pairs:
            own = np.flatnonzero((y == a) | (y == b))
            ones.append(fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0)))
        self.pair_w = np.array(ones, np.float32).reshape(len(ones), DIMS + 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row, and a score from 0 to 1 (the margins put through a logistic curve)."""
        n, rows = len(x), np.arange(len(x))
        squash = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
        score = np.ones(n)
        if len(self.families) > 1:
            margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
            fam = margins.argmax(1)
            score = squash(margins[rows, fam])
        else:
            fam = np.zeros(n, np.int64)
        votes = np.full((n, len(self.langs)), -np.inf)
        for f, m in enumerate(self.members):
            votes[np.ix_(fam == f, m)] = 0
        least = np.full((n, len(self.langs)), np.inf)
        if self.pairs:
            margins = x @ self.pair_w[:, :-1].T + self.pair_w[:, -1]
            for k, (a, b) in enumerate(self.pairs):
                g = margins[:, k].astype(np.float64)
                for v, s in ((a, g), (b, -g)):
                    votes[:, v] += (s > 0) + np.tanh(s) * 1e-3
                    least[:, v] = np.minimum(least[:, v], s)
        best = votes.argmax(1)
        margin = least[rows, best]
        score = score * np.where(np.isinf(margin), 1.0, squash(margin))
        return [self.langs[i] for i in best], score


#: Of each language at least so many texts are drawn (or all that it has).
FEWEST = 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, per_language: int = 600, at_most: int = 6000, seed: int = 8) -> Model | None:
    """Learn from text and lang of `labelled`. A distinct text is drawn if its hash is under its language's share."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    each = max(FEWEST, min(per_language, at_most // len(counts)))
    # Half as many again as are wanted pass the hash, so that the least of them can be taken by a window over few rows.
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 20) / r["count"])) for r in counts], "lang string, share double")
    chance = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    drawn = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("text", "lang", chance.alias("chance")).distinct()
    drawn = drawn.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("chance", "text"))).where(F.col("place") <= each)

    def run(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at in range(0, len(texts), 64):
                part = [(t, v) for t, v in zip(texts[at : at + 64], langs[at : at + 64]) if has_letter(t)]
                x = features([t for t, _ in part])
                digest = [zlib.crc32(t.encode("utf-8", "replace")) for t, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array([v for _, v in part], pa.string()), pa.array(digest, pa.int64()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "digest", "x"])

    got = arrow_map(drawn, run, "lang string, digest long, x binary").collect()  # max(at_most, FEWEST x languages) rows of 8 KB at most
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["digest"], r["x"]))
    return Model(np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32), [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model | None, keep: dict[str, Column]) -> DataFrame:
    """The columns of `keep`, then lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("_text"), *[v.alias(k) for k, v in keep.items()])
    names = list(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                pred, score = ["und"] * len(part), np.zeros(len(part))
                own = [i for i, t in enumerate(part) if t is not None and has_letter(t)] if sent.value else []
                # A few very long texts at a time, so that the n-gram arrays stay small.
                start, size = 0, 0
                for j, i in enumerate(own):
                    size += len(part[i])
                    if size > 1_000_000 or j + 1 == len(own):
                        langs, s = sent.value.predict(features([part[k] for k in own[start : j + 1]]))
                        for k, v, x in zip(own[start : j + 1], langs, s):
                            pred[k], score[k] = v, x
                        start, size = j + 1, 0
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(at, 128) for n in names], pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return arrow_map(rows, run, ", ".join([*[f"`{n}` {kinds[n]}" for n in names], "lang_pred string, score double"]))


def held_out() -> Column:
    """Documents never learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model, {"doc_id": F.col("doc_id").cast("long"), "held_out": held_out()})
