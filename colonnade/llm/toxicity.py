r"""Operator 10, toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector w over sparse word features serves all ordered
thresholds, and the result is the expected severity, the sum of P(grade > k). Features are whether a text holds a
word, or a word that begins with some 4 to 7 bytes (stems of inflected words); they speak for or against toxicity and are kept by
a likelihood-ratio test of association with the label (at least MIN_RATIO) and log odds of at least MIN_ODDS either way; a word of no clean row
passes from 12 toxic rows of equally many toxic and clean ones.

Grades come from the labels where these are graded. Where they only say toxic or not, toxic rows are graded 1 and 2 by cross-fitting:
the rows are dealt into FOLDS folds, the severity of each fold's toxic rows comes from a regression (and a choice of features) that has not seen the fold,
and those over the median are grade 2. Training takes at most MAX_TRAIN rows of each label, chosen by a hash of
doc_id and joined by a broadcast of that bounded size, one text of each doc_id (that of the least hash); only counts of features and, of each
row, the chosen features come to the driver. Scoring takes every row and whole texts.

Null and empty texts have no feature and are not toxic. A row with several labels has the greatest; null labels and null doc_ids
train nothing. Without toxic labels nothing is toxic. Rows are independent; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import ALNUM, Words, map_batches, materialize, text_of

#: Bounds of the training sample and of the vocabulary; the least documents, log odds and likelihood ratio of a kept word.
MAX_TRAIN, MAX_TRAIN_CHARS, MAX_FEATURES, MIN_DOCS, MIN_ODDS, MIN_RATIO, FOLDS = 4_000, 20_000, 2_000, 5, 2.0, 16.0, 2
PREFIXES = (4, 5, 6, 7)


class CumulativeLink:
    """Sparse ordinal regression; rows are arrays of feature numbers."""

    def __init__(self, rows: list[np.ndarray], grades: np.ndarray, n: int, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> None:
        self.k = int(grades.max()) if len(grades) else 1
        at, who = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        cuts = np.array([np.log((np.mean(grades <= k) + 1e-3) / (np.mean(grades > k) + 1e-3)) for k in range(self.k)])
        w, m, v = np.zeros(n), np.zeros(n + self.k), np.zeros(n + self.k)
        balance = np.where(grades > 0, 0.3 / max(1e-9, np.mean(grades > 0)), 0.7 / max(1e-9, np.mean(grades == 0)))
        for t in range(1, steps + 1):
            score = np.bincount(who, w[at], minlength=len(rows))
            slope, cut_slope = np.zeros(len(rows)), np.zeros(self.k)
            p = sigmoid(cuts[None, :] - score[:, None])
            full = np.concatenate([np.zeros((len(rows), 1)), p, np.ones((len(rows), 1))], axis=1)
            i = np.arange(len(rows))
            hi, lo = full[i, grades + 1], full[i, grades]
            like = np.maximum(1e-9, hi - lo)
            d_hi, d_lo = balance * hi * (1 - hi) / like, balance * lo * (1 - lo) / like
            slope = d_hi - d_lo  # of the loss by the score
            for k in range(self.k):
                cut_slope[k] = -(d_hi[grades == k].sum() - d_lo[grades == k + 1].sum())
            g = np.concatenate([np.bincount(at, slope[who], minlength=n) / len(rows) + decay * w, cut_slope / len(rows)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / np.sqrt(1 + t / 20)
            w, cuts = w - step[:n], np.maximum.accumulate(cuts - step[n:])
        self.w, self.cuts = w, cuts

    def expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the likeliest grade."""
        above = 1 - sigmoid(self.cuts[None, :] - score[:, None])
        full = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
        return above.sum(axis=1), (full[:, :-1] - full[:, 1:]).argmax(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Twice the log likelihood ratio of a of n and b of m rows against one share in both; empty cells count nothing."""
    out = np.zeros(len(a))
    for seen, size, held in ((a, n, a + b), (n - a, n, n + m - a - b), (b, m, a + b), (m - b, m, n + m - a - b)):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] * (n + m) / (size * held[some]))
    return out


def parts(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of each feature: words, then their beginnings."""
    return [(words.of, words.hashes), *((words.of[which], h) for which, h in map(words.prefixes, PREFIXES))]


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    row, h = map(np.concatenate, zip(*parts(Words(column, ALNUM)), strict=True))
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(len(column) + 1))
    return [np.unique(h[order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def chosen(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """The features, by place, that a of n toxic and b of m clean rows hold and that are kept, strongest first."""
    odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
    ratio = likelihood_ratio(a, b, n, m)
    keep = np.flatnonzero((a + b >= MIN_DOCS) & (np.abs(odds) >= MIN_ODDS) & (ratio >= MIN_RATIO))
    return keep[np.argsort(-ratio[keep], kind="stable")][:MAX_FEATURES]


def graded(rows: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray, kept: list[np.ndarray], n: int) -> np.ndarray:
    """Grades 0, 1 and 2 of binary labels. kept: for each fold, the features chosen without it."""
    severity = np.full(len(rows), -np.inf)
    for fold, features in enumerate(kept):
        allowed = np.zeros(n, bool)
        allowed[features] = True
        own = [r[allowed[r]] for r in rows]
        others = [r for r, f in zip(own, folds, strict=True) if f != fold]
        if not others or not toxic[folds != fold].any():
            continue
        fit = CumulativeLink(others, toxic[folds != fold].astype(np.int64), n)
        mine = np.flatnonzero((folds == fold) & toxic)
        severity[mine] = [fit.w[own[i]].sum() - fit.cuts[0] for i in mine]
    middle = np.median(severity[toxic])
    return toxic.astype(np.int64) + (toxic & (severity > middle))


class Model:
    """words: hashes of the features, sorted; rows: the features' places in each training row; kept: the places that the model uses
    and, for each fold, those chosen without it."""

    def __init__(self, words: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, kept: list[np.ndarray]) -> None:
        grades = labels.astype(np.int64)
        if grades.max(initial=0) == 1:
            grades = graded(rows, labels > 0, folds, kept[1:], len(words))
        used = np.sort(kept[0])
        self.words = words[used]
        self.maybe = np.zeros(1 << 20, bool)  # by the first 20 bits, to look up few
        self.maybe[self.words >> np.uint64(44)] = True
        rows = [self._places(self.words, words[r]) for r in rows]
        self.fit = CumulativeLink(rows, grades, len(self.words)) if len(self.words) else None

    @staticmethod
    def _places(words: np.ndarray, row: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, row), len(words) - 1)
        return at[words[at] == row]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(column)
        if self.fit is None:
            return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        words = Words(column, ALNUM)
        pairs = [np.zeros(0, np.int64)]
        for row, h in parts(words):
            maybe = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            row, h = row[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            is_in = self.words[at] == h
            pairs.append(row[is_in] * len(self.words) + at[is_in])
        pairs = np.unique(np.concatenate(pairs))
        row, feature = np.divmod(pairs, len(self.words))
        score = np.bincount(row, self.fit.w[feature], minlength=n)
        severity, grade = self.fit.expected(score)
        return severity, grade, sigmoid(score - self.fit.cuts[0]) >= 0.5


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    lab = text_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    picked = None
    for side in (lab.where("grade > 0"), lab.where("grade <= 0")):
        some = side.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
        picked = some if picked is None else picked.union(some)
    texts = text_of(docs, "doc_id", "text").where(F.length("text") <= MAX_TRAIN_CHARS)
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * MAX_TRAIN doc_ids
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade"))
    rows = rows.select("doc_id", "text", F.greatest("grade", F.lit(0)).alias("grade"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array([x.view(np.int64) for x in distinct_features(batch.column(1))], pa.list_(pa.int64()))], names=["doc_id", "grade", "fold", "words"])

    held = materialize(map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, fold int, words array<bigint>"), "training")
    side = (F.col("grade") > 0).alias("toxic")
    sizes = {(r.toxic, r.fold): r.n for r in held.groupBy(side, "fold").agg(F.count("*").alias("n")).collect()}
    if not sum(n for (t, _), n in sizes.items() if t):
        return None
    cells = [(t, f) for t in (True, False) for f in range(FOLDS)]
    spread = held.select(side, "fold", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if((F.col("toxic") == t) & (F.col("fold") == f)).alias(f"c{int(t)}{f}") for t, f in cells), F.count("*").alias("n"))
    # a feature that passes somewhere passes this bound too, which leaves few
    a, b = (sum((F.col(f"c{int(t)}{f}") for f in range(1, FOLDS)), F.col(f"c{int(t)}0")) for t in (True, False))
    n, m = (max(1, sum(sizes.get((t, f), 0) for f in range(FOLDS))) for t in (True, False))
    apart = F.abs(F.log((a + 0.5) / (n - a + 0.5)) - F.log((b + 0.5) / (m - b + 0.5)))
    got = spread.where((F.col("n") >= MIN_DOCS) & (apart >= MIN_ODDS / 2)).orderBy(F.desc(apart * F.sqrt(F.col("n"))), "word").limit(20 * MAX_FEATURES).toPandas().sort_values("word")
    words = got["word"].to_numpy().astype(np.int64).view(np.uint64)
    count = {c: got[f"c{int(c[0])}{c[1]}"].to_numpy() for c in cells}
    kept = []
    for out in (None, *range(FOLDS)):  # with all folds, then without each
        inside = [f for f in range(FOLDS) if f != out]
        kept.append(chosen(sum(count[True, f] for f in inside), sum(count[False, f] for f in inside), max(1, sum(sizes.get((True, f), 0) for f in inside)), max(1, sum(sizes.get((False, f), 0) for f in inside))))
    union = np.unique(np.concatenate(kept))
    kept = [np.searchsorted(union, k) for k in kept]
    order = np.argsort(words[union])
    words, back = words[union][order], np.argsort(order)
    kept = [back[k] for k in kept]
    asked = held.sparkSession.sparkContext.broadcast(words)  # at most (FOLDS + 1) * MAX_FEATURES

    def places(batches):
        for batch in batches:
            column = batch.column(3)
            found = [Model._places(asked.value, np.asarray(x, np.int64).view(np.uint64)) for x in column.to_numpy(zero_copy_only=False)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "grade", "fold", "places"])

    rows = held.mapInArrow(places, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, fold int, places array<bigint>").toPandas().sort_values("doc_id")
    return Model(words, [np.asarray(x, np.int64) for x in rows["places"]], rows["grade"].to_numpy(), rows["fold"].to_numpy(), kept)


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest) and toxic of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        severity, grade, toxic = model.predict(batch.column(1)) if model else (np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool))
        return pa.record_batch([batch.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int64()), pa.array(toxic, pa.bool_())], names=["doc_id", "severity", "grade", "toxic"])

    return map_batches(text_of(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade bigint, toxic boolean")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train(docs, labels))
