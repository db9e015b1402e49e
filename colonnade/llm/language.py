r"""Operator 6, language identification by hierarchical discrimination.

A linear model first predicts the language family; within it, one-versus-one linear support vector machines separate
the related languages, by votes and then margins. Features are hashed letter n-grams (one to three code points, with
word ends) of the whole lower-cased text, as shares of the text's length.

Every language with a label is learned. Training takes at most MAX_TRAIN different rows a language, those with the least hash of
doc_id and text, of at most MAX_TRAIN_CHARS characters each; rows of the held-out fold are never seen. lang, source and doc_id
are no inputs of a prediction.

Null text and text without a letter give `und` with score 0. Without any labelled row every text gives `und`. A
language of an unknown family is a family of its own. Rows are independent, so repeated rows give repeated results; only the named
columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import map_batches, text_of, utf8

#: The families of the languages' codes; others stand alone.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk uz ky tt", "uralic": "fi et hu", "semitic": "ar he mt am", "indo-aryan": "hi ur bn pa gu mr ne si", "baltic": "lt lv", "celtic": "ga cy gd br",
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes.split()}
#: Bounds of the training sample, bits of the feature table, and the held-out fold of crc32(doc_id) mod 4.
MAX_TRAIN, MAX_TRAIN_CHARS, FOLD = 400, 20_000, 2
#: Bits of the feature tables of one, two and three code points.
BITS = (10, 12, 13)
LETTER = regex.compile(r"\p{L}")
DIM = sum(1 << b for b in BITS)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lower-cased texts, ASCII but a-z as spaces, and the n + 1 offsets of the rows; null counts as empty."""
    low = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
    sizes = np.asarray(pc.utf8_length(low), np.int64)
    data, _ = utf8(low)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    signs = (points < 97) | (points > 122) & (points < 128)
    return np.where(signs, np.uint32(32), points), np.concatenate([[0], np.cumsum(sizes)])


def gram_slots(points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Feature slots of the runs of one, two and three code points that end at each one; slots of the three kinds are apart."""
    prev, two = np.full(len(points), 32, np.uint32), np.full(len(points), 32, np.uint32)
    prev[1:], two[2:] = points[:-1], points[:-2]
    first = offsets[:-1][offsets[:-1] < len(points)]
    prev[first] = two[first] = 32
    second = first + 1
    two[second[second < len(points)]] = 32
    k = np.uint32(2654435761)
    pair = (prev * k ^ points) * k
    three = ((two * k ^ prev) * k ^ points) * k
    slot = lambda h, bits: h >> np.uint32(32 - bits)
    return [slot(points * k, BITS[0]), (1 << BITS[0]) + slot(pair, BITS[1]), (1 << BITS[0]) + (1 << BITS[1]) + slot(three, BITS[2])]


class Sample:
    """Shares of the texts' features, sparse: row i has the slots at[i] with the shares of[i]."""

    def __init__(self, texts: list[str]) -> None:
        self.at, self.of = [], []
        for t in texts:
            points, offsets = code_points(pa.array([t], pa.string()))
            slot, n = np.unique(np.concatenate(gram_slots(points, offsets)), return_counts=True)
            self.at.append(slot)
            self.of.append((n / max(1, len(points))).astype(np.float32))

    def scale(self) -> np.ndarray:
        """What brings each feature to a like spread."""
        one, two, n = np.zeros(DIM), np.zeros(DIM), max(1, len(self.at))
        for at, of in zip(self.at, self.of, strict=True):
            one[at] += of
            two[at] += of.astype(np.float64) ** 2
        return np.minimum(1 / (np.sqrt(np.maximum(0, two / n - (one / n) ** 2)) + 1e-3), 300.0).astype(np.float32)

    def dense(self, rows: np.ndarray, scale: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIM), np.float32)
        for k, i in enumerate(rows):
            out[k, self.at[i]] = self.of[i] * scale[self.at[i]]
        return out


def svm(sample: Sample, scale: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged subgradient steps over some rows of the sample; y is -1 or 1 for each of these."""
    rng, w, b = np.random.default_rng(seed), np.zeros(DIM, np.float32), 0.0
    keep, kept_b, n, step = np.zeros_like(w), 0.0, 0, 0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for epoch in range(epochs):
        for _ in range(0, len(y), 32):
            some = rng.integers(0, len(y), 32)
            x = sample.dense(rows[some], scale)
            step += 1
            rate = 4.0 / (1 + 0.01 * step)
            bad = y[some] * (x @ w + b) < 1
            w *= 1 - min(0.5, rate * c)
            if bad.any():
                g = (y[some[bad]] * weight[some[bad]]).astype(np.float32)
                w += rate * (g @ x[bad]) / 32
                b += float(rate * 0.1 * g.sum() / 32)
            if epoch >= epochs // 2:
                keep, kept_b, n = keep + w, kept_b + b, n + 1
    return (keep / max(1, n)).astype(np.float32), kept_b / max(1, n)


class Hierarchy:
    """Columns of one weight matrix: a machine per family (one against the rest), then one per pair within a family."""

    def __init__(self, langs: list[str], texts: list[str]) -> None:
        self.langs = sorted(set(langs))
        family = [FAMILY_OF.get(x, x) for x in self.langs]
        self.families = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == g] for g in self.families]
        y = np.array([self.langs.index(x) for x in langs])
        sample, everyone = Sample(texts), np.arange(len(texts))
        self.scale = sample.scale()
        machines, self.pairs = [], []
        group = np.array([self.families.index(f) for f in family])[y] if len(y) else y
        for g in range(len(self.families)) if len(self.families) > 1 else ():
            machines.append(svm(sample, self.scale, everyone, np.where(group == g, 1, -1)))
        for members in self.members:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    some = np.flatnonzero((y == a) | (y == b))
                    self.pairs.append((a, b))
                    machines.append(svm(sample, self.scale, some, np.where(y[some] == a, 1, -1)))
        self.w = np.stack([m[0] * self.scale for m in machines], axis=1) if machines else np.zeros((DIM, 0), np.float32)
        self.b = np.array([m[1] for m in machines], np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = code_points(column)
        n, size = len(column), np.maximum(1, np.diff(offsets)).astype(np.float64)
        margins = np.zeros((n, self.w.shape[1]))
        full = np.diff(offsets) > 0
        for slots in gram_slots(data, offsets) if len(data) else ():
            margins[full] += np.add.reduceat(self.w[slots], offsets[:-1][full], axis=0)
        margins = margins / size[:, None] + self.b
        k = len(self.families) if len(self.families) > 1 else 0
        fam = margins[:, :k].argmax(axis=1) if k else np.zeros(n, int)
        sure = 1 / (1 + np.exp(-4 * np.clip(margins[np.arange(n), fam], -8, 8))) if k else np.ones(n)
        votes, strength = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, k + j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            strength[:, a] += m
            strength[:, b] -= m
        allowed = np.zeros((len(self.families), len(self.langs)), bool)
        for g, members in enumerate(self.members):
            allowed[g, members] = True
        total = np.where(allowed[fam], votes + 0.5 + np.tanh(strength) / 4, -1.0)
        best = total.argmax(axis=1)
        size_of = allowed.sum(axis=1)[fam]
        inner = np.where(size_of > 1, 1 / (1 + np.exp(-4 * np.clip(strength[np.arange(n), best] / np.maximum(1, size_of - 1), -8, 8))), 1.0)
        return [self.langs[i] for i in best], np.clip(sure * inner, 0, 1)


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, fold: int | None = FOLD) -> Hierarchy | None:
    rows = text_of(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    rows = rows.where(F.coalesce(fold_of(F.col("doc_id")) != fold, F.lit(False))) if fold is not None else rows
    rows = rows.where(F.length("text") <= MAX_TRAIN_CHARS)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    # a little over MAX_TRAIN rows a language pass, repeated ones as one; pairs of a language and the greatest hash that may pass
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.3 * MAX_TRAIN / n + 40 / n)))])
    some = rows.select("lang", "text", spot.alias("spot")).where(F.col("spot") < share[F.col("lang")]).distinct()
    some = some.toPandas().sort_values(["spot", "text"]).groupby("lang").head(MAX_TRAIN)
    return Hierarchy(list(some["lang"]), list(some["text"]))


def identify(docs: DataFrame, model: Hierarchy | None, held_out: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lettered = [bool(t and LETTER.search(t)) for t in batch.column(1).to_pylist()]
        pred, score = (model.predict(batch.column(1)) if model else (["und"] * batch.num_rows, np.zeros(batch.num_rows)))
        pred = [p if ok else "und" for p, ok in zip(pred, lettered, strict=True)]
        return pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(text_of(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == FOLD
