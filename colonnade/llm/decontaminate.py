r"""Operator 3, benchmark decontamination by Wu-Manber multi-pattern search.

Texts are words [0-9a-z and all beyond ASCII] with A-Z lower-cased. Every 8 consecutive words of a benchmark item are
a pattern (an item of fewer words, but not none, is one). The search reads words as Wu-Manber reads characters: a
table over hashed blocks of two words says how far to skip, blocks that end a pattern lead to a bucket of patterns,
and a comparison of the words themselves confirms an occurrence.

The patterns go to every task in blocks of at most max_words words or so: a larger benchmark takes a search for each block.
`contaminated` asks for two items; decontaminate() drops a document that holds a window of one, since eight words in a row
of a benchmark item are a leak wherever they stand and clean texts hold none.

Null text has no words; its row has zeros and the hash of the empty string. Repeated rows give repeated results; an
empty documents table gives no row; an empty benchmark hits nothing; a null item_id is left out of items_sha256 but
counted. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import ALNUM, Words, fresh_name, map_batches, materialize, mix, row_marks, text_of

WINDOW, BLOCK, TABLE_BITS = 8, 2, 20
#: The most words of a benchmark whose patterns are sent to every task at once (some 200 bytes a word).
MAX_WORDS = 400_000
#: `contaminated` from so many items on; a document leaves the corpus from so many items on.
MIN_ITEMS, DROP_ITEMS = 2, 1


class WuManber:
    """Patterns of one length m, in words."""

    def __init__(self, m: int, patterns: dict[bytes, tuple[np.ndarray, set[int]]]) -> None:
        self.m, self.b = m, min(BLOCK, m)
        self.shift = np.full(1 << TABLE_BITS, m - self.b + 1, np.int8)
        self.buckets: dict[int, list[tuple[list[int], bytes, frozenset[int]]]] = {}
        for raw, (hashes, items) in patterns.items():
            blocks = block_hashes(hashes, self.b)
            for q, at in enumerate(blocks.tolist()):
                self.shift[at] = min(self.shift[at], len(blocks) - 1 - q)
            self.buckets.setdefault(int(blocks[-1]), []).append((hashes.tolist(), raw, frozenset(items)))

    def search(self, words: Words, low: np.ndarray) -> tuple[np.ndarray, list[tuple[int, frozenset[int]]]]:
        """A mark on each hit word, and (row, items) of each occurrence."""
        hit, found = np.zeros(len(words.hashes), bool), []
        if len(words.hashes) < self.m:
            return hit, found
        blocks = block_hashes(words.hashes, self.b)
        shifts, m, b = self.shift[blocks].tolist(), self.m, self.b
        rows = words.rows.tolist()
        for row in range(len(rows) - 1):
            at, end = rows[row] + m - b, rows[row + 1] - b  # where a window's last block starts
            while at <= end:
                step = shifts[at]
                if step:
                    at += step
                    continue
                first = at + b - m
                for hashes, raw, items in self.buckets.get(int(blocks[at]), ()):
                    if words.hashes[first] == hashes[0] and words.hashes[first : first + m].tolist() == hashes and normal(words, low, first, m) == raw:
                        hit[first : first + m] = True
                        found.append((row, items))
                at += 1
        return hit, found


def block_hashes(hashes: np.ndarray, b: int) -> np.ndarray:
    if b == 1 or len(hashes) < 2:
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def normal(words: Words, low: np.ndarray, first: int, m: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(words.starts[first : first + m], words.ends[first : first + m], strict=True))


def lowered(words: Words) -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] = fold[97:123]
    return fold[words.data]


def compile_patterns(items: list[tuple[int, str]]) -> list[WuManber]:
    """items: (position, text). One searcher for each pattern length."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    if not items:
        return []
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
    low = lowered(words)
    for (k, _), lo, hi in zip(items, words.rows[:-1], words.rows[1:], strict=True):
        m = min(WINDOW, hi - lo)
        for first in range(lo, hi - m + 1) if m else ():
            known = by_length.setdefault(int(m), {})
            known.setdefault(normal(words, low, first, m), (words.hashes[first : first + m].copy(), set()))[1].add(k)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def blocks_of(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    """The benchmark's rows with a text, in blocks of about max_words words (an item is not split) and 16 bytes a word at most."""
    bench = text_of(benchmark, "item_id", "text").where("text is not null")
    size = bench.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = -(-max(size.n or 0, (size.b or 0) // 16) // max(1, max_words)) if size.n else 1
    return [bench] if n <= 1 else [bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == k) for k in range(2 * n)]


def patterns_of(bench: DataFrame) -> tuple[list[WuManber], list[str | None]]:
    """The searchers of one block, and the name of each item number; item numbers are distinct item_ids."""
    rows = [(r.item_id, r.text) for r in bench.collect()]
    place = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in rows))}
    return compile_patterns([(place[i], t) for i, t in rows]), [None if x is None else str(x) for x in place]


def search_rows(searchers: list[WuManber], column: pa.Array) -> tuple[Words, np.ndarray, list[set[int]]]:
    """The words of the texts, a mark on each hit word, and each row's item numbers."""
    words = Words(column, ALNUM)
    low, hit, items = lowered(words), np.zeros(len(words.hashes), bool), [set() for _ in range(len(column))]
    for searcher in searchers:
        marks, found = searcher.search(words, low)
        hit |= marks
        for row, which in found:
            items[row] |= which
    return words, hit, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and item_ids (sorted strings) of every document."""
    blocks = blocks_of(benchmark, max_words)
    if len(blocks) > 1:
        return by_blocks(docs, blocks)
    searchers, names = patterns_of(blocks[0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, hit, items = search_rows(searchers, batch.column(1))
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[words.rows[1:]] - total[words.rows[:-1]]
        ids = [sorted(names[i] for i in x if names[i] is not None) for x in items]
        return pa.record_batch([batch.column(0), pa.array(np.diff(words.rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "n_items", "item_ids"])

    return map_batches(text_of(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>")


def by_blocks(docs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """The way for benchmarks of any size: one search for each block of patterns, so a task holds one block at a time; a document's
    hits from all blocks are then put together by its row number."""
    base = materialize(text_of(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    each = []
    for bench in blocks:
        searchers, names = patterns_of(bench)

        def run(batch: pa.RecordBatch, searchers=searchers, names=names) -> pa.RecordBatch:
            words, hit, items = search_rows(searchers, batch.column(1))
            spots = [np.flatnonzero(hit[a:b]) for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]
            ids = [[names[i] for i in x] for x in items]
            return pa.record_batch([batch.column(0), pa.array(np.diff(words.rows), pa.int64()), pa.array(spots, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=["row", "n_words", "spots", "ids"])

        if searchers or not each:
            each.append(map_batches(base.select("row", "text"), run, "row bigint, n_words bigint, spots array<int>, ids array<string>"))
    found = reduce(DataFrame.unionAll, each)
    counts = found.groupBy("row").agg(F.max("n_words").alias("n_words"))
    hits = found.select("row", F.explode("spots").alias("k")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    per = found.select("row", F.explode("ids").alias("id")).distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("id")).alias("item_ids"))
    whole = base.select("row", "doc_id").join(counts, "row").join(hits, "row", "left").join(per, "row", "left")
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def digest(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The contract's columns."""
    return find_contamination(docs, benchmark, max_words).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_items") >= MIN_ITEMS).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, least_items: int = DROP_ITEMS) -> DataFrame:
    """The documents, all columns and repeated rows as they are, without those in which windows of least_items benchmark items or more
    occur. Null texts stay; an empty benchmark drops nothing. The verdict is computed beside the row, block after block, without a join."""
    at = docs.columns.index("text")
    for bench in blocks_of(benchmark, max_words) if least_items == 1 else ():
        searchers, _ = patterns_of(bench)
        if searchers:
            docs = map_batches(docs, lambda batch, s=searchers: batch.filter(pa.array([not x for x in search_rows(s, batch.column(at))[2]], pa.bool_())), docs.schema)
    if least_items == 1:
        return docs
    a, b = row_marks(docs, "doc_id", "text")
    names = [fresh_name(docs.columns, c) for c in ("first_mark", "second_mark", "gone_mark")]
    marked = docs.withColumns({names[0]: a, names[1]: b})
    bad = find_contamination(marked.select(F.struct(names[0], names[1]).alias("doc_id"), "text"), benchmark, max_words).where(F.col("n_items") >= least_items).select(F.col("doc_id").alias(names[2])).distinct()
    return marked.join(bad, F.struct(names[0], names[1]) == F.col(names[2]), "left_anti").select(*(marked[f"`{c}`"] for c in docs.columns))


def sha(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
