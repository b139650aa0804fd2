"""Removal of repeated passages by recompression.

A text's words are renamed in rounds: runs of one symbol, then pairs of a left and a right symbol (each symbol's
side in a round is a hash bit of its name), get a name that depends on what they stand for alone. So equal passages
get equal interior symbols, in every text and without a dictionary of names; only a few at a passage's ends differ. Spark rounds:

1. Rounds up to the top give every text one symbol: texts with equal top symbols have equal words. Of such copies
   all but the first lose every word, without further work.
2. A sieve leaves the texts that may share a window of w words with another one. Two rounds of pairs alone leave in any such window at
   least one symbol that its own words determine (with w = 13 it lies between words 3 and 10); the one with the smallest name, named with
   three words on each side, is the window's anchor. A window without a shared anchor has no equal elsewhere.
3. In the texts that are left, every symbol of the rounds that stands for 2 w words or more is looked up by its 128-bit name: one that a
   smaller doc_id has too reveals and verifies a long repeat at once, with all the windows inside it.
4. What long symbols don't cover (passages under some 2 w words, and the ends of longer ones) is decided window by window, at shared
   anchors, by 128-bit names: the smallest doc_id of each such window is found in buckets, and the covered words go.

A name that many texts share is settled in each task first: of the rows of a task, only those of its smallest doc_id move on to the name's bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLOCK, BLOCK_SCHEMA, MAX_ID, Packer, Words, by_bucket, id_text, in_arrow, mix, pieces, prepare, runs, saved, segments, table, unpack

#: Entries in a bucket, about.
BUCKET_ROWS = 700_000
#: Words that two rounds of pairs can leave undetermined at each end of a window, and the longest symbol they make.
MARGIN, LONGEST = 3, 4
#: Of a name: two independent 64-bit halves, by which names are made in a round of pairs and a round of runs.
_PAIRS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD))
_RUNS = ((0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
_ANCHOR = [("name", "<u8"), ("key", "<u8")]
_SPAN = [("name", "<u8"), ("check", "<u8"), ("key", "<u8"), ("id", "<i8"), ("range", "<u8")]
_BY_TEXT = [("key", "<u8"), ("name", "<u8")]
#: Words at to at + n of a text, as at * 2**32 + n.
_RANGE = [("key", "<u8"), ("range", "<u8")]


def _pair_round(names: list[np.ndarray], doc, start, level: int):
    """Names each left symbol and the right one after it in the same text as one; also, which symbols are new."""
    right = (mix(names[0] + np.uint64(0x632BE59BD9B4E019 * (level + 1) % (1 << 64))) >> np.uint64(63)).astype(bool)
    pair = np.zeros(len(doc), bool)
    pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    keep = np.ones(len(doc), bool)
    keep[1:] = ~pair[:-1]
    at, out = np.flatnonzero(pair), []
    for x, (a, b, c) in zip(names, _PAIRS, strict=False):
        made = x.copy()
        made[at] = mix(x[at] * np.uint64(a) + (x[at + 1] ^ np.uint64(b)) * np.uint64(c))
        out.append(made[keep])
    return out, doc[keep], start[keep], pair[keep]


def _run_round(names: list[np.ndarray], doc, start):
    """Names each run of one symbol by the symbol and the run's length; also, which symbols are new."""
    edge = segments(names[0], doc)
    first, length = edge[:-1], np.diff(edge)
    long, out = length > 1, []
    for x, (a, b) in zip(names, _RUNS, strict=False):
        made = x[first]
        made[long] = mix(made[long] * np.uint64(a) + length[long].astype(np.uint64) * np.uint64(b))
        out.append(made)
    return out, doc[first], start[first], long


def _rounds(words: Words, names: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of runs and of pairs in turn: names, texts, first words and newness of all symbols, until every text is one symbol (which then stays out)."""
    state, level = (names, words.doc(), np.arange(len(names[0]))), 0
    while len(state[1]):
        *state, new = _run_round(*state)
        yield *state, new
        *state, new = _pair_round(*state, level)
        yield *state, new
        edge = segments(state[1])
        open_ = np.repeat(np.diff(edge) > 1, np.diff(edge))
        state, level = ([x[open_] for x in state[0]], state[1][open_], state[2][open_]), level + 1


def top_symbols(words: Words, names: np.ndarray) -> np.ndarray:
    """The last symbol of each text (0: no words)."""
    out = np.zeros(len(words.count), np.uint64)
    for (name,), doc, _, _ in _rounds(words, [names]):
        out[doc] = name  # the last round in which a text takes part leaves its one symbol
    return out


def symbols(words: Words, names: list[np.ndarray], least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all rounds that stand for at least so many words: names, text, first word and number of words."""
    found = []
    for state, doc, start, new in _rounds(words, names):
        end = words.bound[1:][doc]
        inner = doc[:-1] == doc[1:]
        end[:-1][inner] = start[1:][inner]
        keep = np.flatnonzero(new & (end - start >= least))
        found.append([*(x[keep] for x in state), doc[keep], start[keep], (end - start)[keep]])
    if not found:
        return [np.zeros(0, np.uint64) for _ in names], *(np.zeros(0, np.int64) for _ in range(3))
    *both, doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
    return both, doc, start, size


def anchors(words: Words, names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of that many words: its first word's place, its anchor's name and place."""
    state = [names], words.doc(), np.arange(len(names))
    for level in range(2):
        *state, _ = _pair_round(*state, level)
    (found,), doc, start = state
    n = len(names)
    ends = np.append(start[1:], n)
    ends = np.minimum(ends, words.bound[1:][doc])
    order = np.full(n + window, np.iinfo(np.uint64).max)
    length = np.full(n + window, LONGEST + 1)
    order[start], length[start] = found, ends - start
    best, place = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.int64)
    stop = window - MARGIN
    for j in range(MARGIN, stop):
        can = (length[j : j + n] <= stop - j) & (order[j : j + n] < best)
        np.copyto(best, order[j : j + n], where=can)
        np.copyto(place, j, where=can)
    left = words.bound[1:][words.doc()] - np.arange(n)
    at = np.flatnonzero(left >= window)
    place = at + place[at]
    around, first = runs(names, words.bound, 2 * MARGIN + 1)
    return at, around[np.searchsorted(first, place - MARGIN)], place


def _classes():
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])

    def run(batches):
        for rows, data, offsets in pieces(batches):
            words = Words(data, offsets)
            top = top_symbols(words, words.hashes())
            raw = data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows["id"], rows["th"], pa.array(top.view(np.int64)), pa.array(words.count), pa.array(sha)], schema=schema)

    return run, "id long, th long, key long, n long, sha string"


def _settle_anchors(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a task's anchors: one row of each to look for others elsewhere, and all rows of those that two of its texts share."""
    rows = rows[np.lexsort((rows["key"], rows["name"]))]
    edge = segments(rows["name"])
    first = edge[:-1]
    known = rows[np.repeat(rows["key"][first] != rows["key"][edge[1:] - 1], np.diff(edge))] if len(rows) else rows
    out = np.empty(len(known), _BY_TEXT)
    out["key"], out["name"] = known["key"], known["name"]
    return rows[first], out


def _anchor_blocks(window: int, buckets: int):
    def run(batches):
        packer, seen = Packer(_ANCHOR, buckets, split=_settle_anchors), set()
        for _, data, offsets in pieces(batches):
            words = Words(data, offsets)
            names = words.hashes()
            at, anchor, place = anchors(words, names, window)
            key = top_symbols(words, names)
            fresh = np.array([k not in seen for k in key.tolist()])
            seen.update(key.tolist())
            if len(seen) > 1_000_000:
                seen.clear()
            if len(place):
                new = np.append(True, place[1:] != place[:-1])
                doc = words.doc()[at]
                new &= fresh[doc]
                yield from packer.add(name=anchor[new], key=key[doc[new]])
        yield from packer.flush()

    return run


def _shared(buckets: int):
    """The anchors that more than one text has, as blocks by text."""

    def work(blocks):
        c = unpack(blocks, _ANCHOR)
        order = np.argsort(c["name"], kind="stable")
        name, key = c["name"][order], c["key"][order]
        edge = segments(name)
        if len(name):
            low, high = np.minimum.reduceat(key, edge[:-1]), np.maximum.reduceat(key, edge[:-1])
            keep = np.repeat(low != high, np.diff(edge))
            name, key = name[keep], key[keep]
        return _packed(_BY_TEXT, buckets, key=key, name=name)

    return work


def _packed(dtype, buckets: int, **columns) -> pa.Table:
    packer = Packer(dtype, buckets)
    made = [*packer.add(**columns), *packer.flush()]
    return pa.Table.from_batches(made, schema=_BLOCK)


def _by_text(dtype, value: str):
    """Of blocks by text: a row for each text with all its values."""

    def work(blocks):
        c = unpack(blocks, dtype)
        order = np.lexsort((c[value], c["key"]))
        key, own = c["key"][order], c[value][order]
        keep = segments(key, own)[:-1]
        key, own = key[keep], own[keep]
        edge = segments(key)
        blobs = [own[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"key": pa.array(key[edge[:-1]].view(np.int64)), "found": pa.array(blobs, pa.binary())})

    return work


def _later(rows) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their 128-bit names, and which of them, in this order, have one that a smaller id has too."""
    order = np.argsort(rows["name"], kind="stable")
    name, check = rows["name"][order], rows["check"][order]
    edge = segments(name)
    if len(order) and (check != np.repeat(check[edge[:-1]], np.diff(edge))).any():  # equal first halves alone
        order = np.lexsort((rows["check"], rows["name"]))
        edge = segments(rows["name"][order], rows["check"][order])
    ids = rows["id"][order]
    return order, ids > np.repeat(np.minimum.reduceat(ids, edge[:-1]), np.diff(edge)) if len(order) else np.zeros(0, bool)


def _settle_spans(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a task's named spans: those of each name's smallest id, and the ranges of all others, which are repeats for certain."""
    order, later = _later(rows)
    known = rows[order[later]]
    out = np.empty(len(known), _RANGE)
    out["key"], out["range"] = known["key"], known["range"]
    return rows[order[~later]], out


def _repeated(buckets: int):
    """The spans whose name a smaller doc_id has too, as blocks by text."""

    def work(blocks):
        c = unpack(blocks, _SPAN)
        order, later = _later(c)
        order = order[later]
        return _packed(_RANGE, buckets, key=c["key"][order], range=c["range"][order])

    return work


def _depth(words: Words, blobs: list[bytes | None], shorter: int = 0) -> np.ndarray:
    """In how many of its text's ranges, each shorter by so many words at its end, a word is."""
    depth = np.zeros(len(words.start) + 1, np.int64)
    for low, blob in zip(words.bound.tolist(), blobs, strict=False):
        if blob:
            own = np.frombuffer(blob, "<u8")
            at = low + (own >> np.uint64(32)).astype(np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + (own & np.uint64(0xFFFFFFFF)).astype(np.int64) - shorter, -1)
    return np.cumsum(depth[:-1])


def _named(rows, words: Words, doc, names: list[np.ndarray], start, size) -> dict[str, np.ndarray]:
    key, ids = rows["key"].to_numpy().view(np.uint64), rows["id"].to_numpy()
    span = ((start - words.bound[doc]).astype(np.uint64) << np.uint64(32)) | np.asarray(size).astype(np.uint64)
    return {"name": names[0], "check": names[1], "key": key[doc], "id": ids[doc], "range": span}


def _symbol_blocks(least: int, buckets: int):
    def run(batches):
        packer = Packer(_SPAN, buckets, split=_settle_spans)
        for rows, data, offsets in pieces(batches):
            words = Words(data, offsets)
            names, doc, start, size = symbols(words, [words.hashes(), words.hashes(seed=1)], least)
            yield from packer.add(**_named(rows, words, doc, names, start, size))
        yield from packer.flush()

    return run


def _window_blocks(window: int, buckets: int):
    def run(batches):
        packer = Packer(_SPAN, buckets, split=_settle_spans)
        for rows, data, offsets in pieces(batches):
            words = Words(data, offsets)
            names = words.hashes()
            at, anchor, _ = anchors(words, names, window)
            hashed, _ = runs(names, words.bound, window)
            check, _ = runs(words.hashes(seed=1), words.bound, window)
            doc = words.doc()[at]
            edge = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            keep = np.zeros(len(at), bool)
            for i, found in enumerate(rows["found"].to_pylist()):
                shared = np.frombuffer(found, "<u8")
                own = anchor[edge[i] : edge[i + 1]]
                keep[edge[i] : edge[i + 1]] = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
            keep &= _depth(words, rows["covered"].to_pylist(), window - 1)[at] == 0  # windows inside a repeated symbol are settled
            yield from packer.add(**_named(rows, words, doc[keep], [hashed[keep], check[keep]], at[keep], np.full(int(keep.sum()), window)))
        yield from packer.flush()

    return run


def _cut():
    def run(batches):
        for rows, data, offsets in pieces(batches):
            words = Words(data, offsets)
            stay = (_depth(words, rows["covered"].to_pylist()) == 0) & (_depth(words, rows["found"].to_pylist()) == 0)
            raw, kept = data.tobytes(), []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                kept.append(b" ".join(compress(raw[a:b].split(), stay[words.bound[i] : words.bound[i + 1]].tolist())).decode())
            left = np.append(0, np.cumsum(stay))[words.bound]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([rows["key"], pa.array(words.count - np.diff(left), pa.int64()), pa.array(kept), pa.array(sha)], names=["key", "cut", "kept", "cut_sha"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Removes each word that lies in a window of that many words whose sequence also starts in a text of a smaller doc_id.

    Words are runs of bytes other than ASCII white space. Windows are judged on the input. Returns one row per row of docs
    (doc_id, text): id, th (xxhash64 of the text), n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text
    (null where nothing or everything was removed). Null texts have no words; texts shorter than a window lose none. A
    null doc_id counts as larger than all others. Rows with one doc_id aren't smaller than each other, so repeated rows
    all stay. Windows and symbols are compared by 128-bit names, copies by their words' SHA-256. Other columns of docs are ignored. No rows give no rows.
    """
    if window < 2 * MARGIN + LONGEST + 3:
        raise ValueError(f"windows under {2 * MARGIN + LONGEST + 3} words may hold no symbol that they determine")
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs).withColumn("th", F.xxhash64("text"))
    run, schema = _classes()
    found = saved(in_arrow(rows, run, schema))
    words = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-words // (4 * BUCKET_ROWS)))
    shared = by_bucket(in_arrow(rows.select("text"), _anchor_blocks(window, buckets), BLOCK_SCHEMA), _shared(buckets), BLOCK_SCHEMA, buckets)
    shared = by_bucket(shared, _by_text(_BY_TEXT, "name"), "key long, found binary")
    first = found.where(F.col("n") >= window).groupBy("key").agg(F.min(F.struct("id", "th", "n")).alias("f"))
    wanted = saved(shared.join(first, "key").select("key", "f.id", "f.th", "f.n", "found"))
    texts = saved(rows.join(wanted, ["id", "th"]).dropDuplicates(["id", "th", "key"]).select("key", "id", "text", "found"))
    open_words = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-open_words // BUCKET_ROWS))

    def repeats(named: DataFrame) -> DataFrame:
        return by_bucket(by_bucket(named, _repeated(buckets), BLOCK_SCHEMA, buckets), _by_text(_RANGE, "range"), "key long, found binary")

    long = repeats(in_arrow(texts.select("key", "id", "text"), _symbol_blocks(2 * window, buckets), BLOCK_SCHEMA))
    texts = saved(texts.join(long.withColumnRenamed("found", "covered"), "key", "left"))
    short = repeats(in_arrow(texts, _window_blocks(window, buckets), BLOCK_SCHEMA))
    hit = texts.select("key", "text", "covered").join(short, "key", "left").where("covered is not null or found is not null")
    cut = in_arrow(hit, _cut(), "key long, cut long, kept string, cut_sha string")

    least = found.groupBy("key", "sha").agg(F.min("id").alias("least"))
    out = found.join(least, ["key", "sha"]).join(cut, "key", "left")
    copy = (F.col("id") > F.col("least")) & (F.col("n") >= window)
    return out.select(
        F.when(F.col("id") != MAX_ID, F.col("id")).alias("doc_id"),
        "th",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~copy & (F.col("cut") > 0), F.col("kept")).alias("kept_text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of remove_repeats()."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, w, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from texts),
windows as (select doc_id, i, case when i + 12 <= len(w) then array_to_string(w[i:i + 12], ' ') end as passage, word from words),
firsts as (select passage, min(doc_id) as first_id from windows where passage is not null group by passage),
marked as (select v.doc_id, v.i, v.word, coalesce(v.doc_id > f.first_id, false) as again from windows v left join firsts f on f.passage = v.passage),
judged as (select *, bool_or(again) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from marked),
kept as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as text from judged group by doc_id)
select t.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from texts t left join kept k on k.doc_id = t.doc_id
"""
