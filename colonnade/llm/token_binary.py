r"""Operator 8, token ids as binary shards with Elias-Fano document boundaries.

A shard holds the concatenated ids of the documents of one range of doc_id. Its file:

    ids, little-endian | Elias-Fano block of the boundaries | keys
    | magic "CTOK", u32 version, u32 id bytes (2 or 4), u64 documents, u64 ids, u64 bytes of the boundaries

An Elias-Fano block stores n ascending numbers: the low l = floor(log2(u / n)) bits of each, packed, then the high
parts as a unary bit vector, then the ones counted before every 512th bit. select(i) finds the i-th one from those
counts, so a number takes 2 + log2(u / n) bits or so, and no table of 64-bit numbers exists, in the file or on reading. The
boundaries are the n + 1 starts of the documents. The keys are u64 null doc_ids, i64 least doc_id and an Elias-Fano block of the
doc_ids less that one; in a shard that keeps its table's order instead, their ascending order and each document's place in it, packed.

Null text counts as empty: a document of the end id alone. Null doc_ids come first. Repeated rows are written as often
as they come; ties in doc_id are ordered by text. An empty table makes no file and no row. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import BATCH_ROWS, text_of
from colonnade.storage import fresh_path

MAGIC, VERSION, HEAD = b"CTOK", 2, struct.Struct("<4sIIQQQ")
#: The id that ends each document, the step of the select samples in bits, and the most words kept in a worker's cache.
END_ID, SAMPLE, MAX_CACHE = 1, 512, 400_000
#: Documents whose spans are read at once.
STEP = 1000
#: Steps of a tokenizer that treat pieces between spaces one by one, and what keeps a text from being cut up here: beyond
#: printable ASCII, line ends and the composed Latin letters, libraries may differ on cases, forms and spaces.
NFC, SPACES, LOWER = {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}
UNUSUAL = re.compile(r"[^\x20-\x7E\n\u00C0-\u012F\u0131-\u024F]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """A tokenizer that drops white space and works on each piece between spaces by itself; pieces are cached as bytes.

    It falls back to whole texts where a tokenizer does not have that property, found out from its file, so ids are
    always those of encode()."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else np.dtype("<u4")
        self.by_word, pattern = self._drops_spaces()
        self.cache = Pieces(self.tokenizer.model, self.dtype, pattern)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _drops_spaces(self) -> tuple[bool, str]:
        import json

        said = json.loads(self.tokenizer.to_str())
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        pre = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (pre.get("pattern") or {}).get("Regex", "")
        usual = steps in ([NFC, SPACES, LOWER], [SPACES, LOWER]) and pre == {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
        rest = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [])[1:]
        usual &= pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and " " not in pattern and "(?" not in pattern
        usual &= [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
        usual &= said["model"]["type"] == "BPE" and not said["truncation"] and not said["padding"] and not said["model"].get("dropout")
        usual &= all(t["content"].startswith("<|") for t in said["added_tokens"])
        return usual, pattern if usual else "x"

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of dtype."""
        if not self.by_word:
            return self._raw(texts)
        get, out = self.cache.__getitem__, []
        for t in texts:
            if (not t.isascii() or not t.isprintable()) and UNUSUAL.search(t) or "<|" in t:
                out.append(self._raw([t])[0])
            else:
                out.append(b"".join(map(get, t.lower().replace("\n", " ").split(" "))))
        return out


class Pieces(dict):
    """Ids of the pieces between spaces, found out when first asked for."""

    def __init__(self, model, dtype: np.dtype, pattern: str) -> None:
        import regex

        self.model, self.dtype, self.find, self.words = model, dtype, regex.compile(pattern).findall, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.shown = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}  # the usual byte alphabet

    def __missing__(self, piece: str) -> bytes:
        got = b"".join(self.words.get(w) or self.word(w) for w in self.find(piece))
        if len(self) < MAX_CACHE and len(piece) < 40:
            self[piece] = got
        return got

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        got = np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()
        if len(self.words) < MAX_CACHE and len(word) < 40:
            self.words[word] = got
        return got


class EliasFano:
    """n + 1 non-decreasing numbers up to u."""

    def __init__(self, n: int, u: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.u, self.low, self.high, self.ranks = n, u, low, high, ranks
        self.l = width(n, u)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        l = width(n, u)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        high[ones] = 1
        marks = np.searchsorted(ones, np.arange(0, len(high) + 1, SAMPLE)).astype("<u4")
        return cls(n, u, packed(values, l), np.packbits(high, bitorder="little"), marks)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.u, len(self.low), len(self.high), len(self.ranks)) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @staticmethod
    def size_of(raw: bytes, at: int) -> int:
        """Bytes of the block that begins at a place of raw."""
        _, _, a, b, c = struct.unpack_from("<QQQQQ", raw, at)
        return 40 + a + b + 4 * c

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, u, a, b, c = struct.unpack_from("<QQQQQ", raw)
        if len(raw) != 40 + a + b + 4 * c:
            raise ValueError("truncated boundaries")
        return cls(n, u, np.frombuffer(raw, np.uint8, a, 40), np.frombuffer(raw, np.uint8, b, 40 + a), np.frombuffer(raw, "<u4", c, 40 + a + b))

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The numbers lo to hi - 1, from the bits between the counts around them alone."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.uint64)
        a, b = (int(np.searchsorted(self.ranks, i, side="right")) for i in (lo, hi - 1))
        bits = np.unpackbits(self.high[(a - 1) * SAMPLE // 8 : b * SAMPLE // 8], bitorder="little")
        skip = lo - int(self.ranks[a - 1])
        ones = (a - 1) * SAMPLE + np.flatnonzero(bits)[skip : skip + hi - lo]
        return (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.l) | unpacked(self.low, self.l, lo, hi)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each number, back to back."""
    each = ((values.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(each.ravel(), bitorder="little")


def unpacked(raw: np.ndarray, bits: int, lo: int, hi: int) -> np.ndarray:
    """The numbers lo to hi - 1 of packed()."""
    first = lo * bits // 8
    held = np.unpackbits(raw[first : (hi * bits + 7) // 8], bitorder="little")[lo * bits - 8 * first :][: (hi - lo) * bits]
    return (held.reshape(hi - lo, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def width(n: int, u: int) -> int:
    return max(0, (u // n).bit_length() - 1) if n else 0


def encode_keys(keys: list[int | None]) -> bytes:
    """The doc_ids: ascending, nulls first, or in another order with a packed place for each document."""
    null = np.array([k is None for k in keys], bool)
    values = np.array([0 if k is None else k for k in keys], np.int64)
    order = np.lexsort((values, ~null))
    moved = bool((order != np.arange(len(keys))).any())
    held = values[order][int(null.sum()) :]
    least = int(held[0]) if len(held) else 0
    out = struct.pack("<QqB", int(null.sum()), least, moved) + EliasFano.build(held.view(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
    if moved:
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        out += packed(place, len(keys).bit_length()).tobytes()
    return out


class Keys:
    """Reads encode_keys()."""

    def __init__(self, raw: bytes, n: int) -> None:
        self.nulls, self.least, moved = struct.unpack_from("<QqB", raw)
        size = EliasFano.size_of(raw, 17)
        self.n, self.held, self.places = n, EliasFano.from_bytes(raw[17 : 17 + size]), np.frombuffer(raw, np.uint8, offset=17 + size) if moved else None

    def range(self, lo: int, hi: int) -> list[int | None]:
        if self.places is not None:
            at = unpacked(self.places, self.n.bit_length(), lo, hi).astype(np.int64)
            return [self.sorted(int(i), int(i) + 1)[0] for i in at]
        return self.sorted(lo, hi)

    def sorted(self, lo: int, hi: int) -> list[int | None]:
        from_, to = max(0, lo - self.nulls), max(0, hi - self.nulls)
        known = (self.held.select_range(from_, to) + np.uint64(self.least % (1 << 64))).view(np.int64)
        return [None] * (hi - lo - len(known)) + known.tolist()


def write_shard(out, ids: Iterator[bytes], dtype: np.dtype, keys: list[int | None]) -> tuple[int, int]:
    """Documents and ids written to the stream; ids yields each document's bytes while keys fills up."""
    counts = []
    for raw in ids:
        counts.append(len(raw) // dtype.itemsize)
        out.write(raw)
    ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.uint64)
    bounds = EliasFano.build(ends).to_bytes()
    side = encode_keys(keys)
    out.write(bounds)
    out.write(side)
    out.write(HEAD.pack(MAGIC, VERSION, dtype.itemsize, len(counts), int(ends[-1]), len(bounds)))
    return len(counts), int(ends[-1])


class Shard:
    """Reads a shard from a file that can be read at any place; offsets come from select(), ids are read as they are asked for."""

    def __init__(self, source) -> None:
        size = source.size()
        if size < HEAD.size:
            raise ValueError("not a token shard")
        magic, version, width_, n, total, bounds = HEAD.unpack(source.read_at(HEAD.size, size - HEAD.size))
        if magic != MAGIC or version != VERSION or width_ not in (2, 4) or total * width_ + bounds > size - HEAD.size:
            raise ValueError("not a token shard")
        self.source, self.dtype, self.n, self.total = source, np.dtype(f"<u{width_}"), n, total
        self.bounds = EliasFano.from_bytes(source.read_at(bounds, total * width_))
        at = total * width_ + bounds
        self.keys = Keys(source.read_at(size - HEAD.size - at, at), n)
        if self.bounds.n != n + 1 or self.bounds.u != total:
            raise ValueError("boundaries and ids disagree")

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.source.read_at((end - start) * self.dtype.itemsize, start * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, table_order: bool = False) -> DataFrame:
    """Write the shards below path (a new folder of the shared one if None) and return their manifest: part, file,
    n_docs, n_tokens. Only files named in the manifest count, so a task that is run again does no harm.

    Documents come in the order of doc_id, or, with table_order, as they stand in the Parquet table that docs reads."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if table_order:
        place = F.col("_metadata.file_path")
        base = docs.select("doc_id", "text", F.length(place).alias("a"), place.alias("b"), F.col("_metadata.row_index").alias("c"))
        order = [F.col("a"), F.col("b"), F.col("c")]
        ranged = base.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    else:
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
        ranged = text_of(docs, "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, keys = WordEncoder.of(tokenizer), []
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()

        def ids() -> Iterator[bytes]:
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 2_000_000):
                        size += len(texts[hi])
                        hi += 1
                    for k, raw in zip(names[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                        keys.append(k)
                        yield raw + end
                    lo = hi

        source = ids()
        head = next(source, None)
        if head is None:
            return
        fs, base_path = filesystem(path)
        fs.create_dir(base_path, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{base_path}/{name}", compression=None) as out:
            n, total = write_shard(out, itertools.chain([head], source), encoder.dtype, keys)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    manifest = ranged.mapInArrow(run, "part int, file string, n_docs bigint, n_tokens bigint")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest").withColumn("path", F.lit(path))


def open_shard(path: str, file: str) -> Shard:
    fs, base = filesystem(path)
    return Shard(fs.open_input_file(f"{base}/{file}"))


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, read from the shards; with ids, its ids too."""
    spark = manifest.sparkSession
    rows = sorted(manifest.select("part", "file", "n_tokens", "path").collect())  # one row a shard
    starts = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows], dtype=np.int64)]) if rows else [0]
    shards = spark.createDataFrame([(r.path, r.file, int(s)) for r, s in zip(rows, starts, strict=False)], "path string, file string, base bigint").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(row["path"], row["file"])
                for lo in range(0, shard.n, STEP):
                    hi = min(shard.n, lo + STEP)
                    bounds = shard.bounds.select_range(lo, hi + 1).astype(np.int64)
                    held = shard.ids(int(bounds[0]), int(bounds[-1]))
                    parts = [held[a:b] for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)]
                    columns = [pa.array(shard.keys.range(lo, hi), pa.int64()), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                    if ids:
                        columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def digest(docs: DataFrame, tokenizer: str | None = None, table_order: bool = False) -> DataFrame:
    """The contract's columns, from files written and read again."""
    return read_tokens(write_tokens(docs, tokenizer=tokenizer, table_order=table_order))
