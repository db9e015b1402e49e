r"""Operator 7, near duplicates by BagMinHash signatures, bands, and verified multiset overlap.

A document is the bag of its 5-word shingles (words [0-9a-z and all beyond ASCII], A-Z lower-cased; fewer words, but
not none, are one shingle), with counts as weights. Weights are discretised at the powers of two: every level
(2^(k-1), 2^k] of a shingle has a Poisson process of its own, thinned by a point's place in its level where a weight
ends inside it. The least point time that each of M registers sees has the weighted Jaccard similarity as its chance to be
equal in two documents. Points come in rising time up to a limit that doubles for documents with open registers.

BANDS bands of ROWS registers find candidates: a pair at similarity 0.8 is missed with a chance of 1.3e-7. Documents of
equal bags are one node. First each bucket's nodes are compared with a pivot, the node that meets most others, which joins
a large group of near copies at one comparison a member. Nodes that still share a bucket with another component meet in a
join on their rarest shingles: two bags that overlap in 0.8 of their union share one of the rarest fifth of each, so early that
what is left suffices for the overlap. So every two nodes that share a bucket end in one component or have been compared or ruled out
exactly. A pair is linked if 10 * overlap >= 8 * union of the bags.

Classes are the connected components; class_id is the least doc_id of the class (null doc_ids last), and one row of each class is
kept: that doc_id's, by the hash of its text if several texts have it. Documents without a word
(null, empty, signs only) are classes of their own. Repeated rows fall in one class; an empty table gives no row.
Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import ALNUM, BATCH_ROWS, Words, bit_filter, chunk_rows, discard, fresh_name, has_bit, map_batches, materialize, mix, row_marks, shingles, text_of

SHINGLE, BANDS, ROWS, M = 5, 40, 5, 200
#: Bits of the counts by which shingles are ordered.
ORDER_BITS = 18
#: A shingle keeps so many bits of its hash beside its row while a chunk is sorted.
HASH_BITS = 48


class Bags:
    """The shingle multisets of a chunk of texts: per (row, shingle) one entry, in order, with its count."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column, ALNUM)
        h, row = shingles(words, SHINGLE)
        key = np.sort(row.astype(np.uint64) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.n, self.total = len(column), np.bincount(row, minlength=len(column))
        self.row = (key[first] >> np.uint64(HASH_BITS)).astype(np.int64)
        self.shingle = key[first] & np.uint64((1 << HASH_BITS) - 1)
        self.count = np.diff(np.concatenate([first, [len(key)]])).astype(np.int64)
        self.bounds = np.searchsorted(self.row, np.arange(self.n + 1))

    def keys(self) -> list[bytes | None]:
        """A 128-bit name of each bag; equal bags have equal names, empty ones none."""
        both = np.stack([self.shingle, self.count.astype(np.uint64)], axis=1)
        return [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """The bag as a set of 64-bit numbers, one for each occurrence, and the n + 1 bounds of the rows."""
        nth = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        out = mix(np.repeat(self.shingle, self.count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64), np.concatenate([[0], np.cumsum(self.total)])


def bag_min_hash(bags: Bags) -> np.ndarray:
    """M registers a row: the least point time, infinite for empty rows."""
    out = np.full((bags.n, M), np.inf)
    limit = np.full(bags.n, 0.0)
    open_rows = bags.total > 0
    limit[open_rows] = (np.log(M) + 4.0) / bags.total[open_rows]
    while open_rows.any():
        some = open_rows[bags.row]
        _points(bags.row[some], bags.shingle[some], bags.count[some], limit, out.ravel())
        open_rows &= np.isinf(out).any(axis=1)
        limit[open_rows] *= 2
    return out


def _points(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    """Lower the registers by every point up to each row's limit."""
    level = 0
    while len(row):
        low = 0 if level == 0 else 1 << (level - 1)  # the level is (low, high] of the weight
        high = 1 << level
        here = count > low
        row, shingle, count = row[here], shingle[here], count[here]
        seed = mix(shingle + np.uint64((level + 1) << 56))
        r, w, rate, j, state, t = row, count, (high - low) * M, 0, seed, np.zeros(len(row))
        while len(r):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            bits = mix(state)
            t = t - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
            keep = t <= limit[r]
            r, w, state, t = r[keep], w[keep], state[keep], t[keep]
            place = mix(state ^ np.uint64(0xA0761D6478BD642F))
            register = ((place >> np.uint64(32)) * np.uint64(M) >> np.uint64(32)).astype(np.int64)
            inside = np.ones(len(r), bool) if level < 2 else low + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * ((high - low) / 2.0**32) < w
            np.minimum.at(out, r[inside] * M + register[inside], t[inside])
            j += 1
        level += 1


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """BANDS numbers a row, different for different bands."""
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(50), bits.shape[:2])
    for j in range(ROWS):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + bits[:, :, j])
    return h.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, mark_a, mark_b (hashes of doc_id and text), key, n, bands of every row."""
    base = text_of(docs, "doc_id", "text")
    a, b = row_marks(base)
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text", a.alias("mark_a"), b.alias("mark_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = Bags(batch.column(1))
        bands = band_hashes(bag_min_hash(bags))
        lists = pa.ListArray.from_arrays(np.arange(0, (bags.n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.ravel(), pa.int64()))
        return pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(bags.keys(), pa.binary()), pa.array(bags.total, pa.int64()), lists], names=["doc_id", "mark_a", "mark_b", "key", "n", "bands"])

    found = map_batches(base, run, "doc_id bigint, mark_a bigint, mark_b bigint, key binary, n bigint, bands array<bigint>")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def bag_sets(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """mark_a, key and the bag as an array, of the documents whose mark_a has its bit set; of rows with one mark, one a task."""
    base = text_of(docs, "doc_id", "text")
    base = base.select(row_marks(base)[0].alias("mark_a"), "text")
    bits = docs.sparkSession.sparkContext.broadcast(bits)  # at most 16 MB
    base.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            marks = np.asarray(whole.column(0))
            keep = has_bit(bits.value, size, marks)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = marks[i] not in seen
                seen.add(int(marks[i]))
            held = whole.filter(pa.array(keep))
            for lo, hi in chunk_rows(held):
                batch = held.slice(lo, hi - lo)
                bags = Bags(batch.column(1))
                values, bounds = bags.sets()
                yield pa.record_batch([batch.column(0), pa.array(bags.keys(), pa.binary()), pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(values, pa.int64()))], names=["mark_a", "key", "bag"])

    return base.mapInArrow(run, "mark_a bigint, key binary, bag array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp of every node of the edges (a, b; written) but those that are their own component's name, by contraction.

    In each round every node goes over to its least neighbour's least neighbour, if that is less, and edges within a node go;
    so the edges shrink, and only maps of one row a node are joined by a name that many rows share."""
    total = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.where("b < a").groupBy("a").agg(F.min("b").alias("to")), "hooks")
        if hook.isEmpty():
            return hook.select(F.col("a").alias("node"), F.col("to").alias("comp")) if total is None else total
        hook = materialize(follow(hook, hook, "to"), "hooks")
        moved = follow(follow(edges.select("a", "b"), hook, "a"), hook, "b").where("a != b")
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        step = hook.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        total = step if total is None else materialize(follow(total, hook, "comp").unionAll(step.join(total, "node", "left_anti")), "labels")


def follow(rows: DataFrame, steps: DataFrame, column: str) -> DataFrame:
    """rows with the column's values taken over from a to `to` by steps, where they have one."""
    held = steps.select(F.col("a").alias("_from"), F.col("to").alias("_to"))
    return rows.join(held, rows[column] == held["_from"], "left").select(*(F.coalesce("_to", column).alias(c) if c == column else F.col(c) for c in rows.columns))


def linked(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b and further columns) whose bags overlap in 0.8 of their union or more."""
    x = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    y = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.where(10 * shared >= 8 * (F.size("bag_a") + F.size("bag_b") - shared)).select(*pairs.columns)


def prefixes(bags: DataFrame) -> DataFrame:
    """node, comp, n, token, place: the rarest fifth of each bag (node, comp, bag) and one more, in order of rarity. Two bags that overlap in 0.8 of
    their union share one of these. Any order that is the same for all bags is right; rarity comes from 2^ORDER_BITS counts."""
    slot = lambda x: (x.view(np.uint64) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            total += np.bincount(slot(np.asarray(batch.column(0).flatten())), minlength=1 << ORDER_BITS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in bags.select("bag").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    shared = bags.sparkSession.sparkContext.broadcast(counts)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, sizes = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets).astype(np.int64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, shared.value[slot(values)], row))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(place < sizes[row] - (4 * sizes[row] + 4) // 5 + 1)
            which = row[keep]
            yield pa.record_batch([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(sizes[which]), pa.array(values[order][keep]), pa.array(place[keep])], names=["node", "comp", "n", "token", "place"])

    return materialize(bags.select("node", "comp", "bag").mapInArrow(run, "node bigint, comp bigint, n bigint, token bigint, place bigint"), "prefixes")


def similar_sizes(n, m) -> F.Column:
    return 10 * F.least(n, m) >= 8 * F.greatest(n, m)


def near_duplicates(docs: DataFrame, left: list[DataFrame] | None = None) -> DataFrame:
    """row, doc_id, mark_a, mark_b, class_id, class_size, kept and has_words of every row. Tables that many rows of one key meet are
    written before the join, so that Spark can split the key's rows among tasks. left gets the tables that the result still reads."""
    rows = materialize(signatures(docs), "signatures")
    full = rows.where("key is not null")
    names = materialize(full.groupBy("key").agg(F.min("row").alias("node")), "nodes")  # a node is a bag's first row
    nodes = materialize(full.join(names.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "key", "mark_a", "n", "bands"), "nodes")
    spots = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = materialize(spots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = materialize(spots.join(sizes, "bucket"), "buckets")
    # a node that meets many others is likely the original of a large group
    weights = shared.groupBy("node").agg(F.sum("size").alias("w"))
    inside = materialize(weights.join(nodes, "node").select("node", "w", "n", "key", "mark_a"), "inside")
    bits, size = bit_filter(inside, "mark_a", inside.count())
    sets = materialize(inside.select("node", "key", "mark_a").join(bag_sets(docs, bits, size), ["mark_a", "key"]).groupBy("node").agg(F.first("bag").alias("bag")), "bags")
    # first with one pivot a bucket, which settles large groups of near copies
    crowd = materialize(shared.select("bucket", "node").join(inside.select("node", "w", "n"), "node"), "crowd")
    discard(shared)
    pivots = materialize(crowd.groupBy("bucket").agg(F.max(F.struct("w", "node", "n")).alias("p")), "pivots")
    pairs = crowd.join(pivots, "bucket").where((F.col("node") != F.col("p.node")) & similar_sizes(F.col("n"), F.col("p.n")))
    pairs = materialize(pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), "pairs")
    parts = components(materialize(linked(pairs, sets), "links"))
    discard(pairs)
    labels = materialize(inside.select("node").join(parts, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "labels")
    # then all nodes that still share a bucket with another component
    placed = materialize(crowd.select("bucket", "node").join(labels, "node"), "placed")
    discard(crowd)
    discard(inside)
    mixed = materialize(placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("bucket"), "mixed")
    rest = materialize(placed.join(mixed, "bucket").select("node", "comp").distinct(), "rest")
    rest_bags = materialize(sets.join(rest, "node"), "rest_bags")
    tokens = prefixes(rest_bags)
    discard(rest_bags)
    met = materialize(tokens.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("token"), "met")
    tokens, whole = materialize(tokens.join(met, "token"), "met_tokens"), tokens
    discard(whole)
    x, y = (tokens.select("token", *(F.col(c).alias(c + i) for c in ("node", "comp", "n", "place"))) for i in "12")
    most = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))  # can be shared from the first shared one on
    close = (F.col("node1") < F.col("node2")) & (F.col("comp1") != F.col("comp2")) & similar_sizes(F.col("n1"), F.col("n2")) & (9 * most >= 4 * (F.col("n1") + F.col("n2")))
    pairs = materialize(x.join(y, "token").where(close).select(F.col("node1").alias("a"), F.col("node2").alias("b"), "comp1", "comp2").distinct(), "pairs")
    between = linked(pairs, sets).select(F.least("comp1", "comp2").alias("a"), F.greatest("comp1", "comp2").alias("b")).distinct()
    parts = materialize(components(materialize(between, "links")).select(F.col("node").alias("a"), F.col("comp").alias("to")), "parts")
    labels = materialize(follow(labels, parts, "comp"), "labels")
    for done in (sets, tokens, pairs, sizes, nodes):
        discard(done)
    # from nodes to rows
    named = materialize(names.join(labels, "node", "left").select("key", F.coalesce("comp", "node").alias("comp")), "names")
    placed = materialize(full.select("row", "doc_id", "mark_a", "mark_b", "key").join(named, "key").drop("key"), "placed")
    wordless = materialize(rows.where("key is null").select("row", "doc_id", "mark_a", "mark_b"), "wordless")
    discard(rows)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark_a", "mark_b", "row")
    first = materialize(placed.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("class_size")), "classes")
    out = placed.join(first, "comp").select("row", "doc_id", "mark_a", "mark_b", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lit(True).alias("has_words"))
    if left is not None:
        left += [placed, first, wordless]
    alone = wordless.select("row", "doc_id", "mark_a", "mark_b", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(False).alias("has_words"))
    return out.unionAll(alone)


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its class, the class's size, and whether it is the one to keep, which holds for one row of each class."""
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each class: the least doc_id's (null last); of several rows of that doc_id, the one whose
    text and then whose other columns have the least hash. Rows without a word all stay."""
    a, b, c, d, held = (fresh_name(docs.columns, x) for x in ("mark_1", "mark_2", "found_1", "found_2", "row_of"))
    left: list[DataFrame] = []
    verdicts = near_duplicates(docs, left).groupBy("mark_a", "mark_b").agg(F.max("kept").alias("kept"), F.max("has_words").alias("has_words"), F.count("*").alias("n"))
    verdicts = materialize(verdicts.where("not kept or has_words and n > 1").select(F.col("mark_a").alias(c), F.col("mark_b").alias(d), "kept"), "verdicts")
    for done in left:
        discard(done)
    mark_a, mark_b = row_marks(docs, "doc_id", "text")
    marked, same = docs.withColumns({a: mark_a, b: mark_b}), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))
    columns = lambda df: [df[f"`{x}`"] for x in docs.columns]
    out = marked.join(verdicts.drop("kept").hint("merge"), same, "left_anti")  # verdicts grow with the documents
    again = verdicts.where("kept").drop("kept")
    if again.isEmpty():
        return out.select(*columns(out))
    twice = marked.join(again, same, "left_semi")
    once = twice.groupBy(a, b).agg(F.min_by(F.struct(*columns(twice)), F.struct(*row_marks(docs))).alias(held))
    return out.select(*columns(out)).unionAll(once.select(*(F.col(held)[x].alias(x) for x in docs.columns)))
