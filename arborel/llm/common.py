"""What the text operators share: session set-up, scratch tables, word hashing and block exchange.

Words are cut and hashed with numpy over the Arrow buffers, so that no Python object is made per word.
Per-word results move between executors as *blocks*: a task packs what belongs to one bucket of keys
into one binary cell, so Spark shuffles few large rows, and a bucket (of bounded size, as the number of
buckets follows the input) is read by one call. Keys are combined in each task first, so a hot key
arrives once per task and not once per row.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy handles at once; bounds a Python worker's memory.
PIECE = 1 << 20
#: Rows in an Arrow batch; texts may be long.
BATCH_ROWS = 1000
MAX_ID = (1 << 63) - 1

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII character but letters and digits; bytes of other scripts count as letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]


# --- session ---------------------------------------------------------------------------------------


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches, and this package on the executors' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_arborel_shipped", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "arborel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._arborel_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a local one only if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark.sparkContext, "_arborel_scratch", None)
        if not base:
            base = spark.sparkContext._arborel_scratch = "file://" + tempfile.mkdtemp(prefix="arborel-")
    return f"{base.rstrip('/')}/arborel-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and it outlives executors."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Columns id (null: the largest id) and text (null: empty), whatever else docs holds."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def absent(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of docs has, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words -----------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By how many bytes of the last eight belong to a word.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: every eight bytes are mixed, then mixed again with their place, and summed. Other seeds give independent hashes."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # those that begin at each byte
    size = end - start
    key = mix(np.array([seed + 1], np.uint64) * _STEP)[0]
    out = mix(mix((eights[start] & _MASK[np.minimum(size, 8)]) ^ key) + _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        times = (size[long] - 1) // 8
        first = np.cumsum(times) - times
        place = np.arange(int(times.sum())) - np.repeat(first, times) + 1
        at = np.repeat(start[long], times) + 8 * place
        left = np.minimum(np.repeat(end[long], times) - at, 8)
        part = mix(mix((eights[at] & _MASK[left]) ^ key) + (place + 1).astype(np.uint64) * _STEP)
        out[long] += np.add.reduceat(part, first)
    return mix(out + size.astype(np.uint64) * key)


class Words:
    """The words of some texts: byte spans in data, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = ASCII_SPACE):
        self.data, self.offsets = data, offsets
        full = ~space[data]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        some = offsets[1:] > offsets[:-1]
        at = offsets[:-1][some]
        first[at] |= full[at]
        at = offsets[1:][some] - 1
        last[at] |= full[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, offsets)  # words of text i: bound[i] to bound[i + 1]
        self.count = np.diff(self.bound)

    def hashes(self, lower: bool = False, ends: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """A 64-bit name of each word, or of its bytes up to ends; lower: A-Z count as a-z."""
        ends = self.end if ends is None else ends
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            low = self.start[i]
            data = self.data[low : self.end[j - 1]]
            out[i:j] = hash_spans(_LOWER[data] if lower else data, self.start[i:j] - low, ends[i:j] - low, seed)
            i = j
        return out

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column (null: empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterable[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about PIECE bytes of text, with the bytes and their offsets."""
    for batch in batches:
        data, at = text_buffers(batch.column(batch.schema.get_field_index(name)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def runs(values: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all k consecutive values within a text, and the place of the first of each."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(k):
        out += values[j : j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    good = np.ones(n, bool)
    for end in bound[1:-1]:
        good[max(0, end - k + 1) : end] = False
    at = np.flatnonzero(good)
    return mix(out[at]), at


def shingle_sets(words: Words, k: int, lower: bool = True) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with fewer words, all of them as one."""
    names = words.hashes(lower)
    hashed, at = runs(names, words.bound, k)
    cut = np.searchsorted(at, words.bound)
    out = []
    for i, n in enumerate(words.count):
        if n >= k:
            out.append(np.unique(hashed[cut[i] : cut[i + 1]]))
        elif n:
            own = names[words.bound[i] : words.bound[i + 1]]
            short, _ = runs(own, np.array([0, n]), int(n))
            out.append(mix(short + np.uint64(n)))  # apart from the k-word ones
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- blocks ----------------------------------------------------------------------------------------

BLOCK_SCHEMA = "bucket int, block binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])


class Packer:
    """Gathers rows of numpy columns and gives them out as one block for each bucket of the key column.

    split(rows) may part the rows into those to be grouped by key and those whose answer this task knows already; the latter go, by their own
    first column, to buckets from `buckets` on, which by_bucket() hands through. So a hot key arrives once per task and not once per row.
    deal(rows) may give other 64-bit values than the key column to choose buckets by.
    """

    def __init__(self, dtype: list[tuple[str, str]], buckets: int, limit: int = 12 << 20, split: Callable | None = None, deal: Callable | None = None):
        self.dtype, self.buckets, self.limit, self.split, self.deal = np.dtype(dtype), buckets, limit, split, deal
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        if n:
            part = np.empty(n, self.dtype)
            for name, values in columns.items():
                part[name] = values
            self.parts.append(part)
            self.size += part.nbytes
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        rows = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        if self.split:
            rows, known = self.split(rows)
            yield from self._blocks(known, self.buckets)
        yield from self._blocks(rows, 0)

    def _blocks(self, rows: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        names = rows.dtype.names
        bucket = bucket_of(self.deal(rows) if self.deal else rows[names[0]], self.buckets)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        rows, edges = rows[order], np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            own = rows[edges[b] : edges[b + 1]]
            blob = b"".join([len(own).to_bytes(8, "little"), *(np.ascontiguousarray(own[c]).tobytes() for c in names)])
            yield pa.RecordBatch.from_arrays([pa.array([b + shift], pa.int32()), pa.array([blob], pa.binary())], schema=_BLOCK)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def unpack(blocks: Iterable[bytes], dtype: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The columns of some blocks, one after another."""
    found: dict[str, list[np.ndarray]] = {name: [] for name, _ in dtype}
    for blob in blocks:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for name, kind in dtype:
            found[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(found[name]) if found[name] else np.zeros(0, kind) for name, kind in dtype}


def in_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def by_bucket(blocks: DataFrame, work: Callable[[list[bytes]], pa.Table], schema: str, buckets: int | None = None) -> DataFrame:
    """work() on the blocks of each bucket, in one call; those from `buckets` on are handed through to the bucket of that number less `buckets`."""

    def one(group: pa.Table) -> pa.Table:
        if buckets is not None and (b := group["bucket"][0].as_py()) >= buckets:
            return pa.table({"bucket": pa.array([b - buckets] * group.num_rows, pa.int32()), "block": group["block"]})
        return work(group["block"].to_pylist())

    return blocks.groupBy("bucket").applyInArrow(one, schema)


def segments(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)
