"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of an item is a seed, so an edited copy is found as long as one is left. Around seeds, the document's words are aligned
with the item's, which bears substitutions, insertions and deletions. Before that, windows are dropped that can't reach the limit: an
alignment of score s has m matches and fewer than m - s + 1 breaks between them, so s - 1 of the item's word pairs at least stand in the
window. Texts aren't moved: one scan finds all, and the items are broadcast in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, absent, mix, pieces, prepare, runs, table, text_buffers

#: Bytes of item texts in a block, which is what is broadcast at once.
BLOCK_BYTES = 8 << 20
_MAP_BITS = 22
_CELLS = 1 << 20


def _of_item(pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Names of word pairs as an item's own."""
    return mix(pairs + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Items:
    """A block of items: their words' names and n-grams."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        data, offsets = text_buffers(pa.array([t for _, t in rows], pa.string()))
        words = Words(data, offsets, NOT_ALNUM)
        names = words.hashes(lower=True)
        self.ids = [i for i, _ in rows]
        self.words = [names[a:b] for a, b in zip(words.bound[:-1], words.bound[1:], strict=True)]
        grams, at = runs(names, words.bound, n)
        item = np.searchsorted(words.bound, at, "right") - 1
        self.grams, inverse = np.unique(grams, return_inverse=True)
        order = np.argsort(inverse, kind="stable")  # places of each gram: edge[g] to edge[g + 1]
        self.item, self.place = item[order], (at - words.bound[item])[order]
        self.edge = np.searchsorted(inverse[order], np.arange(len(self.grams) + 1))

        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.grams >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True
        pairs, at = runs(names, words.bound, 2)
        self.pairs = np.unique(_of_item(pairs, np.searchsorted(words.bound, at, "right") - 1))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the grams are known, and as which."""
        at = np.flatnonzero(self.map[(grams >> np.uint64(64 - _MAP_BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[found] == grams[at] if len(self.grams) else np.zeros(0, bool)
        return at[same], found[same]


def _likely(items: Items, names: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Which windows of the words hold as many of their item's word pairs as an alignment that counts."""
    pairs, _ = runs(names, np.array([0, len(names)]), 2)
    length = np.array([len(w) for w in items.words])[item]
    count, size = np.zeros(len(item), np.int64), np.maximum(high - low - 1, 0)
    total, a = np.cumsum(size), 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + _CELLS, "right")))
        start = np.append(0, np.cumsum(size[a:b]))
        at = np.repeat(low[a:b] - start[:-1], size[a:b]) + np.arange(start[-1])
        own = _of_item(pairs[at], np.repeat(item[a:b], size[a:b]))
        known = items.pairs[np.minimum(np.searchsorted(items.pairs, own), len(items.pairs) - 1)] == own if len(items.pairs) else np.zeros(len(own), bool)
        count[a:b] = np.diff(np.append(0, np.cumsum(known))[start])
        a = b
    return count >= least * length - 1


def align(item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment of the item with each text (match 1, mismatch -1, gap -1): its score, and the end of its part of the text."""
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    order = np.argsort([len(t) for t in texts], kind="stable")
    low, step = 0, np.arange(len(item), dtype=np.int32)
    while low < len(order):
        high = min(len(order), low + max(1, _CELLS // max(1, len(item))))
        own = order[low:high]
        longest = len(texts[own[-1]])
        grid = np.zeros((len(own), longest), np.uint64)
        inside = np.zeros((len(own), longest), bool)
        for r, i in enumerate(own):
            grid[r, : len(texts[i])], inside[r, : len(texts[i])] = texts[i], True
        row = np.zeros((len(own), len(item)), np.int32)
        for t in range(longest):
            same = (grid[:, t : t + 1] == item[None, :]) & inside[:, t : t + 1]
            new = np.where(same, 1, -1).astype(np.int32)
            new[:, 1:] += row[:, :-1]
            np.maximum(new, row - 1, out=new)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + step, axis=1) - step  # gaps in the text
            top = row.max(axis=1)
            better = top > best[own]
            best[own[better]], end[own[better]] = top[better], t + 1
        low = high
    return best, end


def spans(items: Items, data: np.ndarray, offsets: np.ndarray, least: float) -> list[list[dict]]:
    """Of each text: the parts that align with an item, as item_id, start and end (in words) and score."""
    words = Words(data, offsets, NOT_ALNUM)
    names = words.hashes(lower=True)
    grams, at = runs(names, words.bound, items.n)
    hit, gram = items.hits(grams)
    out: list[list[dict]] = [[] for _ in words.count]
    if not len(hit):
        return out
    times = items.edge[gram + 1] - items.edge[gram]
    entry = np.repeat(items.edge[gram] - np.cumsum(times) + times, times) + np.arange(times.sum())
    item, place = items.item[entry], items.place[entry]
    at = np.repeat(at[hit], times)
    doc = np.searchsorted(words.bound, at, "right") - 1
    length = np.array([len(w) for w in items.words])[item]
    slack = np.maximum(length // 3 + 3, ((1 - least) * length).astype(np.int64) + 1)  # no alignment that counts has more gaps
    low = np.maximum(words.bound[doc], at - place - slack)
    high = np.minimum(words.bound[doc + 1], at - place + length + slack)
    order = np.lexsort((high, low, doc, item))
    item, doc, low, high = item[order], doc[order], low[order], high[order]
    first = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] > high[:-1]))
    item, doc, low, high = item[first], doc[first], low[first], high[np.append(first[1:], True)]
    good = _likely(items, names, item, low, high, least)
    windows: dict[int, list[tuple[int, int, int, int]]] = {}
    for w in zip(item[good].tolist(), doc[good].tolist(), low[good].tolist(), high[good].tolist(), strict=True):
        windows.setdefault(w[0], []).append(w)
    for i, own in windows.items():
        word = items.words[i]
        while own:  # what is left and right of a found part may hold more copies
            score, end = align(word, [names[a:b] for _, _, a, b in own])
            good = [(w, int(s), int(e)) for w, s, e in zip(own, score, end, strict=True) if s >= max(1, least * len(word))]
            _, back = align(word[::-1], [names[a : a + e][::-1] for (_, _, a, _), _, e in good])
            own = []
            for ((_, d, a, b), s, e), n in zip(good, back.tolist(), strict=True):
                stop = a + e - int(words.bound[d])
                out[d].append({"item_id": items.ids[i], "start": stop - n, "end": stop, "score": round(s / len(word), 4)})
                own += [(i, d, x, y) for x, y in ((a, a + e - n), (a + e, b)) if y - x >= least * len(word)]
            if own:
                likely = _likely(items, names, *np.array(own)[:, [0, 2, 3]].T, least)
                own = [w for w, good in zip(own, likely.tolist(), strict=True) if good]
    for found in out:
        found.sort(key=lambda k: k["start"])
    return out


_SPANS = "array<struct<item_id: long, start: int, end: int, score: double>>"


def _span_column(shared, least: float, text: Column) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(column: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in pieces([pa.RecordBatch.from_arrays([column], names=["text"])]):
            out += spans(shared.value, data, offsets, least)
        return pa.array(out, kind)

    return F.arrow_udf(run, _SPANS).asNondeterministic()(text)  # else a later filter computes it again


def with_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, name: str = "leaks") -> DataFrame:
    """docs (with a column text) and a new column of that name: the parts that align with an item of benchmark (item_id, text).

    An alignment counts if its score (matches less mismatches and gaps, in words) is least or more of the item's words.
    It is looked for where n words in a row are the item's, so a copy without any such run isn't found.
    Words are runs of letters and digits, A-Z lower-cased. Each entry has item_id, start, end (words of the document) and score;
    no leak: an empty array. Null texts count as empty. Items of fewer than n words, or null, never match. Repeated
    rows and items are judged each by itself. All columns of docs stay; one that has the new column's name is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    bytes_ = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-bytes_ // BLOCK_BYTES) or 1
    columns = []
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([tuple(r) for r in own], n)
        if not len(items.grams):
            continue
        columns.append(_span_column(spark.sparkContext.broadcast(items), least, F.col("text")))
    found = F.concat(*columns) if columns else F.array().cast(_SPANS)
    return docs.withColumn(name, found)


def query(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark text: doc_id, item_ids, n_leaks, best_score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leaks").where(F.size("leaks") > 0)
    return found.select(
        "doc_id",
        F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"),
        F.size("leaks").cast("long").alias("n_leaks"),
        F.array_max("leaks.score").alias("best_score"),
    )


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark text, with their columns as they are."""
    (name,) = absent(docs, "_leaks")
    return with_leaks(docs, table(spark, sf_dir, "benchmark"), name=name).where(F.size(name) == 0).select(*docs.columns)
