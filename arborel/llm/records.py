"""Token-id shards: length-delimited records with masked checksums, and an offset index beside each.

A shard holds the documents of one range of doc_id, in ascending order. Record: the payload's length (8 bytes),
the length's masked CRC-32C (4), the payload, its masked CRC-32C (4), all little-endian. Payload: one document's
ids as unsigned integers of 2 bytes, or of 4 where the vocabulary needs them. The index has one entry of 24 bytes for
each record, (doc_id, offset of the record, ids), so a reader can fetch records in any shuffled order.
A shard is written under another name and then renamed, so a repeated task leaves the same whole file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, id_text, in_arrow, prepare, saved, scratch, table, width
from .crc32c import frames, unframe

#: Bytes of words and their ids that a worker remembers, from one task to the next.
KNOWN_BYTES = 128 << 20
#: Bytes of text in a shard, about.
SHARD_BYTES = 512 << 20
#: Bytes of text that are encoded and framed at once.
CHUNK = 4 << 20
#: ASCII marks, which after a letter or digit a-z, 0-9 are tokens by themselves. (An apostrophe may begin an ending; special tokens begin with "<|".)
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])


class Encoder:
    """Ids of texts, word by word with a memory: white space always parts tokens in this kind of vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() < 1 << 16 else "I"
        self.kind = f"<u{array(self.code).itemsize}"
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0
        self.bare = self._bare()

    def _bare(self):
        """The model alone, which gives words of letters a-z the same ids without the steps before it; None where a vocabulary has other ids for them."""
        bare = type(self.tokenizer).from_str(self.tokenizer.to_str())
        bare.normalizer = bare.pre_tokenizer = None
        tried = ["a", "the", "don", "straightforwardness", "qzxjkvw"]
        same = lambda w: bare.encode(w, add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids
        return bare if all(map(same, tried)) else None

    def _learn(self, new: set[bytes]) -> None:
        """Remembers the ids of words that aren't known."""
        plain, other, cut = [], [], []
        for word in new:
            if self.bare and word.isalpha() and word.islower():
                plain.append(word)
            elif (stem := word.rstrip(_MARKS)) != word and stem[-1:].isalnum() and b"<|" not in word:
                cut.append((word, stem, word[len(stem) :]))
            else:
                other.append(word)
        if cut:
            self._learn({p for _, *parts in cut for p in parts if p not in self.known and p not in new})
        if plain:  # as the words of one sequence, with one row of ids
            e = self.bare.encode([w.decode() for w in plain], is_pretokenized=True, add_special_tokens=False)
            ids, size = np.array(e.ids, self.kind).tobytes(), np.dtype(self.kind).itemsize
            at = (np.searchsorted(np.array(e.word_ids), np.arange(len(plain) + 1)) * size).tolist()
            self._remember(plain, [ids[a:b] for a, b in pairwise(at)])
        if other:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
            self._remember(other, [array(self.code, e.ids).tobytes() for e in found])
        self._remember([word for word, _, _ in cut], [self.known[stem] + self.known[marks] for _, stem, marks in cut])

    def _remember(self, words: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.bytes += sum(map(len, words)) + sum(map(len, ids)) + 150 * len(words)  # with what the objects and the entries take

    def texts(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """The ids of each text, and end, as bytes of kind."""
        # Upper case is lost anyway; where a special token may stand, case matters.
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if self.bytes > KNOWN_BYTES:
            self.known.clear()
            self.bytes = 0
        every = [*chain.from_iterable(words)]
        ids = [*map(self.known.get, every)]
        gaps = [i for i, x in enumerate(ids) if x is None]
        self._learn({every[i] for i in gaps})
        for i in gaps:
            ids[i] = self.known[every[i]]
        bound = [0, *accumulate(map(len, words))]
        return [b"".join([*ids[a:b], end]) for a, b in pairwise(bound)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder a worker, which outlives a task."""
    return Encoder(path)


def _chunks(batches):
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            ids.append(i)
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name, own = f"{root}/shard-{shard:06d}", f"{root}/.{uuid.uuid4().hex}"
        out = encoder = None
        index, offset, total = [], 0, 0
        for ids, texts in _chunks(batches):
            if out is None:
                files.create_dir(root, recursive=True)
                encoder, out = _encoder(vocabulary), files.open_output_stream(own)
                end = np.array([end_id], encoder.kind).tobytes()
            payloads = encoder.texts(texts, end)
            records = frames(payloads)
            sizes = np.array([len(r) for r in records])
            part = np.empty(len(ids), _INDEX)
            part["doc_id"], part["offset"], part["n"] = ids, offset + np.cumsum(sizes) - sizes, [len(p) // len(end) for p in payloads]
            out.write(b"".join(records))
            index.append(part)
            offset += int(sizes.sum())
            total += int(part["n"].sum())
        if out is None:
            return
        out.close()
        with files.open_output_stream(own + ".index") as f:
            f.write(np.concatenate(index).tobytes())
        files.move(own + ".index", name + ".index")
        files.move(own, name + ".records")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([len(end)], pa.int32())], names=["shard", "tokens", "id_bytes"])

    return run


def write_token_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Writes the ids of every whole text, each followed by end_id, as shards in folder, a URI that all executors reach.

    Order: doc_id ascending, null last; rows that share a doc_id by a hash of the text. Null texts are empty: their record
    holds end_id alone. Repeated rows are written as often as they stand. Other columns of docs are ignored. Returns
    (shard, tokens, id_bytes, start) for each shard that has rows; start counts the ids of all shards before it. The number of
    shards (one for SHARD_BYTES of text, and no fewer than shuffle partitions), not of documents, bounds what the driver gets. No rows: no files, no rows. vocabulary: a tokenizers
    file on every executor whose tokens never span white space.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs)
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(width(spark), -(-size // SHARD_BYTES))
    rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", F.xxhash64("text"))
    done = saved(in_arrow(rows, _write(folder, vocabulary, end_id), "shard int, tokens long, id_bytes int")).orderBy("shard").collect()
    start, out = 0, []
    for shard, tokens, id_bytes in done:
        out.append((shard, tokens, id_bytes, start))
        start += tokens
    return spark.createDataFrame(out, "shard int, tokens long, id_bytes int, start long").repartition(max(1, len(out)), "shard")


def read_index(folder: str, shard: int) -> np.ndarray:
    """The index entries (doc_id, offset, n) of a shard."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/shard-{shard:06d}.index") as f:
        return np.frombuffer(f.read(), _INDEX)


def read_records(folder: str, shard: int, entries: np.ndarray, id_bytes: int) -> list[np.ndarray]:
    """The ids of the records that the entries name, in their order, checksums verified."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    out = []
    with files.open_input_file(f"{root}/shard-{shard:06d}.records") as f:
        for e in entries:
            raw = f.read_at(int(e["n"]) * id_bytes + 16, int(e["offset"]))
            out.append(np.frombuffer(unframe(raw, [0])[0], f"<u{id_bytes}"))
    return out


def _read(folder: str):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64())])

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard, start, kind = row["shard"], row["start"], f"<u{row['id_bytes']}"
                index = read_index(folder, shard)
                with files.open_input_file(f"{root}/shard-{shard:06d}.records") as f:
                    low = 0
                    while low < len(index):
                        begin = int(index["offset"][low])
                        high = max(low + 1, int(np.searchsorted(index["offset"], begin + CHUNK)))
                        stop = int(index["offset"][high]) if high < len(index) else f.size()
                        part = index[low:high]
                        payloads = unframe(f.read_at(stop - begin, begin), (part["offset"] - np.uint64(begin)).tolist())
                        ids = [np.frombuffer(p, kind) for p in payloads]
                        n = np.array([len(x) for x in ids])
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                        first = start + np.cumsum(n) - n
                        start += int(n.sum())
                        columns = [part["doc_id"].astype(np.int64), first, n, np.array(crc, np.int64), np.full(len(n), shard, np.int32), part["offset"].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
                        low = high

    return run


def read_token_records(shards: DataFrame, folder: str) -> DataFrame:
    """One row per record of the shards that write_token_records() returned, read back from the files with checksums verified:
    doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (of the ids as 4-byte integers), shard, offset."""
    out = in_arrow(shards, _read(folder), "id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")
    return out.select(F.when(F.col("id") != MAX_ID, F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "offset")


def token_records(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as token records to a new folder in the shared one, and returns the rows of read_token_records()."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch(docs.sparkSession)
    return read_token_records(write_token_records(docs, vocabulary, folder), folder)


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document, read back from its record: doc_id, start, n_tokens, ids_crc32, shard, offset."""
    return token_records(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: all docs as token records, a row for each."""
    return token_records(docs)
