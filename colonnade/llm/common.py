"""Shared pieces of the text operators: shared storage, Arrow batches and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import storage

#: Characters of text that one vectorised step works on; bounds a worker's memory.
CHUNK_BYTES = 2_000_000
#: Rows per Arrow batch handed to Python.
BATCH_ROWS = 1_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    path = storage.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    if df is not None:
        storage.delete(df.sparkSession, df._written)


def row_marks(df: DataFrame, *columns: str) -> tuple[F.Column, F.Column]:
    """Two hashes of the columns (all of them if none is named), 128 bits together: rows that agree in both are equal in these columns."""
    fields = [f for f in df.schema if not columns or f.name in columns]
    values = [F.map_entries(df[f"`{f.name}`"]) if isinstance(f.dataType, T.MapType) else df[f"`{f.name}`"] for f in fields]
    # a null leaves a hash as it is, so the nulls' places are hashed too
    nulls = F.concat(*(F.when(v.isNull(), "1").otherwise("0") for v in values))
    return F.xxhash64(nulls, *values), F.xxhash64(F.lit(1), nulls, *values)


def fresh_name(taken: list[str], base: str) -> str:
    """A column name that does not clash with any of taken, in any case."""
    low, name = {x.lower() for x in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash."""
    return docs.select(*[docs[c] for c in columns])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """fn over Arrow batches of at most BATCH_ROWS rows; it returns one batch, or a list of them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunk_rows(batch):
                out = fn(batch.slice(lo, hi - lo))
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def chunk_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES of text each; a longer text has a range of its own."""
    at = batch.schema.get_field_index("text")
    if at < 0 or not batch.num_rows:
        if batch.num_rows:
            yield 0, batch.num_rows
        return
    sizes = np.asarray(pc.binary_length(batch.column(at)).fill_null(0), dtype=np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield lo, hi
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P, _PI = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PI)):
            steps = np.full(max(n, CHUNK_BYTES + 8), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def byte_table(is_word: Callable[[int], bool], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in words, and each byte's hash value, A-Z as a-z if fold."""
    word = np.array([is_word(b) for b in range(256)])
    values = _BYTES.copy()
    if fold:
        values[65:91] = values[97:123]
        word[65:91] = word[97:123]
    return word, values


#: Words [0-9a-z and all beyond ASCII], A-Z lower-cased.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, True)
#: Words [^\x20\x09-\x0D].
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13, False)


class Words:
    """The words of a chunk of texts: byte ranges, hashes, and the n + 1 word offsets of the rows."""

    __slots__ = ("data", "starts", "ends", "hashes", "rows", "of", "_total", "_down")

    def __init__(self, column: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> None:
        self.data, offsets = utf8(column)
        inside, n = table[0][self.data], len(self.data)
        first = offsets[:-1][offsets[:-1] < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[first] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[1][self.data] * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.rows = np.searchsorted(self.starts, offsets)
        self.of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.rows))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than size bytes, and a hash of the first size bytes of each, apart from word hashes."""
        which = np.flatnonzero(self.ends - self.starts > size)
        at = self.starts[which]
        return which, mix((self._total[at + size] - self._total[at]) * self._down[at] + np.uint64(size << 32))

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi as they stand, joined by one space each."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of each row, and its row; a row of fewer words, but not none, has one."""
    counts = np.diff(words.rows)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), made)
    first = np.repeat(words.rows[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(len(row))
    size, h = np.minimum(counts, k)[row], np.zeros(len(row), np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        h = np.where(j < size, h * np.uint64(0x2545F4914F6CDD1D) + padded[first + j], h)
    return mix(h + size.astype(np.uint64)), row


def bit_filter(df: DataFrame, column: str, n: int, most_bytes: int = 16 << 20) -> tuple[np.ndarray, int]:
    """Bits at pmod(column, size) for a long column: a filter of at most most_bytes, however many rows there are."""
    size = 1 << 20
    while size < 16 * n and size < 8 * most_bytes:
        size *= 2
    at = F.pmod(F.col(column), F.lit(size))
    words = df.select((at / 64).cast("long").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return out.view(np.uint64), size


def has_bit(bits: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, size).astype(np.uint64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
