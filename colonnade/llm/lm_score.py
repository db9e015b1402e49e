r"""Operator 9, language-model scoring by masked pseudo-likelihood.

A window network in numpy predicts every word from the two words on either side, the word itself being masked. Words
([0-9a-z and all beyond ASCII], A-Z lower-cased) are told apart by hashes of 64 bits. The network's output is a hierarchical softmax
over LEAVES leaves: log P(word | context) = log P(class | context) + log P(leaf | class, context) + log P(word | leaf). The TOP most
frequent words have a leaf each, and so are predicted themselves; the others share REST leaves by their hash, and within
these exact counts of the whole corpus tell them apart. A document's score is the sum over all its words.

The counts are a table in the shared folder, with a row for each word, and grow with the corpus. The most frequent words, HEAD at
most, are broadcast; all other words of the documents meet their counts in a join. Words in no document of the counts
share the mass of one occurrence in their leaf.

Counts and training cover every document, and scores do not depend on how the rows are dealt over partitions: documents go to shards of about
SHARD_WORDS words by a hash of doc_id and text, and within a shard stand in the hash's order. In each round every shard starts from the
same weights and takes each of its words as a target once, in steps of BATCH words; the shards' moves, rounded to whole numbers so that sums do not
depend on their order, are averaged by their words. A task adds up its shards' moves, tasks' moves are added in two
stages, and only the model itself, whose size is fixed, comes to the driver and goes back to the tasks.

Null and empty texts, and texts without a word, have 0 words, a log-likelihood of 0 and no mean. Repeated rows get
equal scores; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import ALNUM, BATCH_ROWS, Words, chunk_rows, materialize, text_of

#: Leaves that words share, leaves of one class, classes, and words with a leaf of their own.
REST, MEMBERS, CLASSES = 64, 64, 64
LEAVES = MEMBERS * CLASSES
TOP = LEAVES - REST
#: Width of the hidden layer, and words on either side.
WIDTH, SIDE = 16, 2
PLACES = 2 * SIDE
#: Rounds of averaging, words of a shard, targets a step, rate, the squared gradient counted at the start, and the units of a summed move.
ROUNDS, SHARD_WORDS, BATCH, RATE, FIRST, UNIT, UNIT_WORDS = 1, 1 << 21, 8192, 0.15, 1.0, 1 << 20, 1 << 10
#: Targets that are worked on at once, and what sums the members of a softmax.
BLOCK, ONES = 4096, np.ones(64, np.float32)
#: Words whose counts are broadcast, distinct words that a counting task holds, and the unit of a summed logarithm.
HEAD, HELD, LOG_UNIT = 1 << 18, 1 << 20, 1 << 32
#: Numbers of the model in one piece that tasks send.
PIECE = 8192


class Vocabulary:
    """The words with a leaf of their own, most frequent first, in a table without collisions."""

    BITS = 22

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.factor = words.astype(np.uint64), np.uint64(0)
        rng = np.random.default_rng(5)
        while len(words):
            self.factor = np.uint64(int(rng.integers(0, 1 << 62)) * 2 + 1)
            if len(np.unique(self._spot(self.words))) == len(words):
                break

    def _spot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self.factor) >> np.uint64(64 - self.BITS)

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.BITS, np.int16)
        out[self._spot(self.words)] = np.arange(len(self.words))
        return out

    def leaves(self, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        rest = (hashes & np.uint64(REST - 1)).astype(np.int32)
        if not len(self.words):
            return rest
        rank = table[self._spot(hashes)]
        return np.where(self.words[rank] == hashes, rank.astype(np.int32) + REST, rest)


class Network:
    """Weights in one flat array: an embedding for each place of the window, then the two output layers."""

    SIZES = (PLACES * (LEAVES + 1) * WIDTH, WIDTH * CLASSES, CLASSES, CLASSES * WIDTH * MEMBERS, LEAVES)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        embed, out, bias, leaf_out, leaf_bias = np.split(flat, np.cumsum(self.SIZES)[:-1])
        self.embed, self.out, self.bias = embed.reshape(PLACES, LEAVES + 1, WIDTH), out.reshape(WIDTH, CLASSES), bias
        self.leaf_out, self.leaf_bias = leaf_out.reshape(CLASSES, WIDTH, MEMBERS), leaf_bias.reshape(CLASSES, MEMBERS)

    @classmethod
    def first(cls, leaf_counts: np.ndarray) -> Network:
        """Small random weights, and biases that give every leaf its share of the corpus."""
        rng = np.random.default_rng(11)
        held = leaf_counts.reshape(CLASSES, MEMBERS) + 0.5
        parts = [rng.normal(0, 0.1, n) for n in cls.SIZES]
        parts[2], parts[4] = np.log(held.sum(axis=1) / held.sum()), np.log(held / held.sum(axis=1, keepdims=True)).ravel()
        return cls(np.concatenate(parts).astype(np.float32))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: one row for each place."""
        total = self.embed[0].take(context[0], axis=0)
        for k in range(1, PLACES):
            total += self.embed[k].take(context[k], axis=0)
        return np.tanh(total, out=total)

    def log_probs(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log P(leaf | context) of each target; context has a column for each of them."""
        order, runs = by_class(leaf)
        context, member, out = context.take(order, axis=1), leaf[order] % MEMBERS, np.zeros(len(leaf))
        for c, lo, hi in runs:
            for a in range(lo, hi, BLOCK):
                b = min(hi, a + BLOCK)
                h = self.hidden(context[:, a:b])
                z, y = h @ self.out + self.bias, h @ self.leaf_out[c] + self.leaf_bias[c]
                found = z[:, c] + y[np.arange(b - a), member[a:b]]
                out[order[a:b]] = found - np.log(exps(z) @ ONES) - np.log(exps(y) @ ONES)
        return out

    def gradient(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of minus the sum of log_probs, by the flat weights."""
        made = Network(np.zeros_like(self.flat))
        order, runs = by_class(leaf)
        context, member = context.take(order, axis=1), leaf[order] % MEMBERS
        h = self.hidden(context)
        p = exps(h @ self.out + self.bias)
        p /= (p @ ONES)[:, None]
        p[np.arange(len(p)), leaf[order] // MEMBERS] -= 1
        made.out[:], made.bias[:], back = h.T @ p, p.sum(axis=0), p @ self.out.T
        for c, lo, hi in runs:
            own = h[lo:hi]
            p = exps(own @ self.leaf_out[c] + self.leaf_bias[c])
            p /= (p @ ONES)[:, None]
            p[np.arange(hi - lo), member[lo:hi]] -= 1
            made.leaf_out[c], made.leaf_bias[c] = own.T @ p, p.sum(axis=0)
            back[lo:hi] += p @ self.leaf_out[c].T
        back *= 1 - h * h
        back = np.ascontiguousarray(back.T)
        for k in range(PLACES):
            for j in range(WIDTH):
                made.embed[k, :, j] = np.bincount(context[k], back[j], minlength=LEAVES + 1)
        return made.flat


def by_class(leaf: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order in which the targets of a class stand together, and each class's run."""
    classes = (leaf // MEMBERS).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES))]).tolist()
    return order, [(c, bounds[c], bounds[c + 1]) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def exps(z: np.ndarray) -> np.ndarray:
    """In place; sums of 64 of them cannot overflow."""
    return np.exp(np.minimum(z, 80, out=z), out=z)


class Trainer:
    """Gradient steps of one shard, each weight with a rate of its own, which falls with its past gradients."""

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.start, self.rate = flat, rate
        self.fresh()

    def fresh(self) -> None:
        self.net, self.past, self.seen = Network(self.start.copy()), np.full(len(self.start), FIRST, np.float32), 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, context: np.ndarray, leaf: np.ndarray, last: bool = False) -> None:
        """Take targets; steps are made of BATCH of them, wherever the calls cut them."""
        self.held.append((context, leaf))
        self.waiting += len(leaf)
        if self.waiting < BATCH and not last:
            return
        context, leaf = np.concatenate([c for c, _ in self.held], axis=1), np.concatenate([x for _, x in self.held])
        end = len(leaf) if last else len(leaf) // BATCH * BATCH
        for a in range(0, end, BATCH):
            self._step(context[:, a : min(a + BATCH, end)], leaf[a : min(a + BATCH, end)])
        self.held, self.waiting = [(context[:, end:], leaf[end:])], len(leaf) - end

    def _step(self, context: np.ndarray, leaf: np.ndarray) -> None:
        g = self.net.gradient(context, leaf)
        self.past += g * g
        g /= np.sqrt(self.past)
        g *= self.rate
        self.net.flat -= g
        self.seen += len(leaf)

    def moved(self) -> tuple[np.ndarray, int]:
        """The shard's move times its words, in whole units, and its words in units; then all begins anew."""
        self.add(np.zeros((PLACES, 0), np.int32), np.zeros(0, np.int32), last=True)
        weight = -(-self.seen // UNIT_WORDS)
        move = np.rint((self.net.flat - self.start).astype(np.float64) * UNIT).astype(np.int64) * weight
        self.fresh()
        return move, weight


def windows(words: Words, vocabulary: Vocabulary, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context leaves of every word's window, a row for each place (LEAVES beyond a text's ends), and the word's leaf."""
    n = len(words.hashes)
    leaf = vocabulary.leaves(words.hashes, table)
    first, last = words.rows[words.of], words.rows[words.of + 1]
    padded = np.concatenate([np.full(SIDE, LEAVES, np.int32), leaf, np.full(SIDE, LEAVES, np.int32)])
    at, context = np.arange(n), np.empty((PLACES, n), np.int32)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        inside = at + step >= first if step < 0 else at + step < last
        context[k] = np.where(inside, padded[SIDE + step : SIDE + step + n], LEAVES)
    return context, leaf


class WordCounts:
    """How often each word occurs: a stored table of word (the hash as a signed number) and n, the vocabulary of the most frequent
    words, and the sums of the leaves that the others share."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        top = table.orderBy(F.desc("n"), "word").limit(TOP).toArrow()  # TOP rows
        self.vocabulary = Vocabulary(np.asarray(top.column("word")).astype(np.int64).view(np.uint64))
        top_n = np.asarray(top.column("n")).astype(np.int64)
        self.total, self.distinct = np.zeros(REST, np.int64), np.zeros(REST, np.int64)
        level = F.floor(F.log2("n") * 16).cast("int")  # some 1,000 levels at most
        levels: dict[int, int] = {}
        for r in table.groupBy(F.pmod("word", F.lit(REST)).cast("int").alias("leaf"), level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
            self.total[r["leaf"]] += r["n"]
            self.distinct[r["leaf"]] += r["words"]
            levels[r["level"]] = levels.get(r["level"], 0) + r["words"]
        own = (self.vocabulary.words & np.uint64(REST - 1)).astype(np.int64)
        np.subtract.at(self.total, own, top_n)
        np.subtract.at(self.distinct, own, 1)
        self.leaf_counts = np.concatenate([self.total, top_n, np.zeros(TOP - len(top_n), np.int64)])
        least, held = None, 0
        for k in sorted(levels, reverse=True):
            held += levels[k]
            if held > HEAD:
                break
            least = k
        self.complete = held <= HEAD
        head = table.where(level >= least) if least is not None else table.limit(0)
        got = head.toArrow()
        words, n = np.asarray(got.column("word")).astype(np.int64).view(np.uint64), np.asarray(got.column("n")).astype(np.int64)
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]

    def sum(self) -> int:
        return int(self.leaf_counts.sum())


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(words, kind="stable")
    words, n = words[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(docs: DataFrame) -> WordCounts:
    """How often each word occurs in all documents."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        out = lambda words, n: pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
        for batch in batches:
            for lo, hi in chunk_rows(batch):
                parts.append(np.unique(Words(batch.column(0).slice(lo, hi - lo), ALNUM).hashes, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield out(*parts[0])
                        parts, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        yield out(*merged(parts))

    return WordCounts(materialize(text_of(docs, "text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words"))


def add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces at hand: a task holds one of each number, at most a model."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("v").to_pylist(), strict=True):
            v = np.frombuffer(raw, np.int64)
            held[piece] = held[piece] + v if piece in held else v.copy()
    yield piece_batch(held)


def piece_batch(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["piece", "v"])


def train(docs: DataFrame, counts: WordCounts, rounds: int = ROUNDS) -> Network:
    spark, net = docs.sparkSession, Network.first(counts.leaf_counts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shards = max(1, -(-counts.sum() // SHARD_WORDS))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 64))
    base = text_of(docs, "doc_id", "text").where("text is not null")
    base = base.select(F.xxhash64("doc_id", "text").alias("h"), "text").select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "text")
    vocabulary = counts.vocabulary
    for k in range(rounds):
        flat, rate = spark.sparkContext.broadcast(net.flat), RATE / (1 + k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, table, total, weight, at = Trainer(flat.value, rate), vocabulary.table(), np.zeros(len(flat.value), np.int64), 0, None  # noqa: B023
            for batch in batches:
                shard = np.asarray(batch.column(0))
                cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                    if b > a and shard[a] != at:
                        if at is not None:
                            move, n = own.moved()
                            total, weight = total + move, weight + n
                        at = shard[a]
                    part = batch.slice(a, b - a)
                    for lo, hi in chunk_rows(part):
                        own.add(*windows(Words(part.column(2).slice(lo, hi - lo), ALNUM), vocabulary, table))
            move, n = own.moved()
            total, weight = total + move, weight + n
            pieces = {i: total[a : a + PIECE] for i, a in enumerate(range(0, len(total), PIECE))}
            yield piece_batch(pieces | {-1: np.array([weight], np.int64)})

        dealt = base.repartition(tasks, "shard").sortWithinPartitions("shard", "h", F.length("text"))
        sent = dealt.mapInArrow(run, "piece int, v binary").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
        several = sent.repartition(F.col("piece"), F.col("group")).select("piece", "v").mapInArrow(add_pieces, "piece int, v binary")
        steps = materialize(several.repartition(F.col("piece")).mapInArrow(add_pieces, "piece int, v binary"), "moves")
        found = {r.piece: np.frombuffer(r.v, np.int64) for r in steps.collect()}  # a model
        if weight := int(found.pop(-1, np.zeros(1, np.int64))[0]):
            move = np.concatenate([found[i] for i in range(len(found))])
            net = Network(net.flat + (move / weight / UNIT).astype(np.float32))
        flat.unpersist()
    return net


class Inside:
    """log P(word | leaf) of the words at hand, smoothed by one for words that share a leaf, and each shared leaf's value for a word without a count."""

    def __init__(self, counts: WordCounts) -> None:
        self.complete, self.unseen = counts.complete, -np.log(counts.total + counts.distinct + 1.0)
        self.words, self.n = counts.words, counts.n
        self.logs = np.log(self.n + 1.0) + self.unseen[(self.words & np.uint64(REST - 1)).astype(np.int64)]

    def of(self, words: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logarithms, which words are known to occur once, and which have to be looked up in the table; these have 0."""
        logs, once, away = np.zeros(len(words)), np.zeros(len(words), bool), np.zeros(len(words), bool)
        some = np.flatnonzero(leaf < REST)
        words, leaf = words[some], leaf[some]
        here = np.zeros(len(words), bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            here = self.words[at] == words
            logs[some[here]] = self.logs[at[here]]
            once[some[here]] = self.n[at[here]] == 1
        if self.complete:
            logs[some[~here]] = self.unseen[leaf[~here]]
        else:
            away[some[~here]] = True
        return logs, once, away


def score(docs: DataFrame, net: Network, counts: WordCounts) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood and n_once (words that occur once in the corpus) of every row."""
    inside = Inside(counts)
    model = docs.sparkSession.sparkContext.broadcast((net.flat, inside, counts.vocabulary))  # about 7 MB, whatever the input
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, within, vocabulary = model.value
        own, table = Network(flat), vocabulary.table()
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo, hi in chunk_rows(whole):
                batch = whole.slice(lo, hi - lo)
                words = Words(batch.column(1), ALNUM)
                context, leaf = windows(words, vocabulary, table)
                each, once, away = within.of(words.hashes, leaf)
                each += own.log_probs(context, leaf)
                rest = np.concatenate([[0], np.cumsum(away)])[words.rows]
                lists = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(words.hashes[away].view(np.int64)))
                total, single = np.bincount(words.of, each, minlength=batch.num_rows), np.bincount(words.of[once], minlength=batch.num_rows)
                yield pa.record_batch([batch.column(0), pa.array(row + np.arange(batch.num_rows)), pa.array(np.diff(words.rows), pa.int64()), pa.array(total, pa.float64()), pa.array(single, pa.int64()), lists], names=["doc_id", "row", "n_words", "ll", "n_once", "rest"])
                row += batch.num_rows

    part = text_of(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, row bigint, n_words bigint, ll double, n_once bigint, rest array<bigint>")
    ll, once = F.col("ll"), F.col("n_once")
    if not inside.complete:
        part = materialize(part, "scores")  # rows have their numbers once
        unseen = F.element_at(F.array(*map(F.lit, inside.unseen.tolist())), F.pmod("word", F.lit(REST)).cast("int") + 1)
        log = F.log(F.coalesce("n", F.lit(0)) + F.lit(1.0)) + unseen
        looked = part.select("row", F.explode("rest").alias("word")).join(counts.table, "word", "left").select("row", F.round(log * LOG_UNIT).cast("bigint").alias("v"), (F.col("n") == 1).cast("bigint").alias("o"))
        part = part.drop("rest").join(looked.groupBy("row").agg(F.sum("v").alias("v"), F.sum("o").alias("o")), "row", "left")
        ll, once = ll + F.coalesce("v", F.lit(0)) / F.lit(float(LOG_UNIT)), once + F.coalesce("o", F.lit(0))
    return part.select("doc_id", "n_words", ll.alias("log_likelihood"), F.when(F.col("n_words") > 0, ll / F.col("n_words")).alias("mean_log_likelihood"), once.alias("n_once"))


def digest(docs: DataFrame) -> DataFrame:
    counts = word_counts(docs)
    return score(docs, train(docs, counts), counts)
