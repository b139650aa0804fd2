"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt by hash to shards of bounded size, in which they stand in doc_id order as one run of words, cut
into blocks of (nearly) equal size. The number of blocks that the mix takes goes to the sources, and a source's to its
shards, by highest quotients votes / (2 seats + 1). In a shard of m blocks with quota q each block is taken q // m times, and
q % m of them, chosen by a seeded permutation, once more. Documents take what their blocks take, so only sizes move.
"""

from __future__ import annotations

import heapq
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, MAX_ID, Words, absent, pieces, prepare, saved, table, text_buffers

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
#: Words may be taken so often at most.
REPEATS = 2
SEED = 17
#: Words of a block at most, and the number of blocks below which blocks get smaller.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 1 << 17
#: Words of a shard, about; and shards beyond one for each source, at most about. The driver gets a row for each source and for each shard.
SHARD_WORDS, MOST_SHARDS = 2_000_000, 50_000


def word_count(text: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        counts = [Words(data, offsets, ASCII_SPACE).count for _, data, offsets in pieces([pa.RecordBatch.from_arrays([column], names=["text"])])]
        return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(run, "long").asNondeterministic()(text)


def fill_targets(sizes: list[int], weights: list[int], total: Fraction, most: int = REPEATS) -> list[Fraction]:
    """Shares of total by weight; those above most times their size stop there, and their excess is shared again until none is above."""
    out, open_, rest = [Fraction(0)] * len(sizes), list(range(len(sizes))), Fraction(total)
    while open_:
        each = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else each * weights[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def sainte_lague(votes: list[Fraction], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 seats + 1), ties to the first; no one gets more than the cap."""
    seats, total = min(seats, sum(caps)), sum(votes)
    # What surely is won already: a little fewer seats than the plain share; the rest goes one by one.
    out = [min(cap, max(0, math.floor(v * seats / total - Fraction(1, 2)) - 1)) if total else 0 for v, cap in zip(votes, caps, strict=True)]
    while sum(out) > seats:  # many small shares can win too much at first
        i = max((i for i in range(len(out)) if out[i]), key=lambda i: Fraction(2 * out[i] - 1) / votes[i])
        out[i] -= 1
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _plan(spark, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, th, source, size): the rows with their shard, and for each shard its words, blocks, quota and permutation."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["size"] for r in found]
    total = sum(sizes)
    goals = fill_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))], SHARE * total)
    per_shard = max(SHARD_WORDS, total // MOST_SHARDS)
    sources = spark.createDataFrame(
        [(i, r["source"], r["size"], float(g), max(1, -(-r["size"] // per_shard))) for i, (r, g) in enumerate(zip(found, goals, strict=True))],
        "rank int, source string, source_size long, target double, shards int",
    )
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "rank", "id", "th", "size", "source_size", "target", F.pmod(F.xxhash64("id", "th", F.lit(SEED)), F.col("shards")).cast("int").alias("shard")
    )
    block = max(1, min(BLOCK_WORDS, total // LEAST_BLOCKS))
    shards = [r for r in placed.groupBy("rank", "shard").agg(F.sum("size").alias("words")).orderBy("rank", "shard").collect() if r["words"]]
    blocks = [-(-r["words"] // block) for r in shards]
    own: dict[int, list[int]] = {}
    for i, r in enumerate(shards):
        own.setdefault(r["rank"], []).append(i)
    counts = {s: sum(blocks[i] for i in at) for s, at in own.items()}
    order = sorted(own)
    votes = [goals[s] * counts[s] / sizes[s] for s in order]  # blocks that reach the target
    seats = sainte_lague(votes, round(sum(votes)), [REPEATS * counts[s] for s in order])
    plan = []
    for s, quota in zip(order, seats, strict=True):
        at = own[s]
        parts = sainte_lague([Fraction(blocks[i]) for i in at], quota, [REPEATS * blocks[i] for i in at])
        for i, q in zip(at, parts, strict=True):
            m = blocks[i]
            draw = random.Random(f"{SEED}:{s}:{shards[i]['shard']}")
            step = draw.randrange(1, m + 1)
            while math.gcd(step, m) != 1:
                step = draw.randrange(1, m + 1)
            plan.append((s, shards[i]["shard"], shards[i]["words"], m, q, step, draw.randrange(m)))
    return placed, spark.createDataFrame(plan, "rank int, shard int, words long, blocks long, quota long, step long, first long")


def mix_plan(docs: DataFrame) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source).

    Sources in code point order, null last, weigh 5, 2, 1 and so on again; the mix is 1.5 times all words, no word is taken more than
    twice. Returns doc_id, th (xxhash64 of the text), source_size, target (its source's words in the mix), size, taken, and
    parts: the runs of words (start, end, times) that are taken once or twice. Words are runs of bytes other than ASCII white space. Null
    and empty texts have size 0 and take 0; a null doc_id sorts last. Repeated rows stand beside each other. Other columns of docs are
    ignored. The result depends on the rows alone, not on their order. No rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "source", word_count(F.col("text")).alias("size"))
    placed, plan = _plan(spark, saved(rows))
    run = Window.partitionBy("rank", "shard").orderBy("id", "th").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.join(plan, ["rank", "shard"], "left").withColumn("stop", F.sum("size").over(run)).withColumn("start", F.col("stop") - F.col("size"))
    block = lambda word: F.expr(f"(({word}) * blocks - 1) div words")
    parts = F.expr(
        """filter(transform(sequence(k0, k1), k -> named_struct(
             'start', greatest(start, (k * words) div blocks) - start, 'end', least(stop, ((k + 1) * words) div blocks) - start,
             'times', cast(quota div blocks + if((k * step + first) % blocks < quota % blocks, 1, 0) as int))), p -> p.times > 0)"""
    )
    at = at.withColumns({"k0": block("start + 1"), "k1": block("stop")})
    at = at.withColumn("parts", F.when(F.col("size") > 0, parts).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,times:int>>)")))
    taken = F.expr("aggregate(parts, 0L, (n, p) -> n + (p.end - p.start) * p.times)")
    return at.select(F.when(F.col("id") != MAX_ID, F.col("id")).alias("doc_id"), "th", "size", "source_size", "target", taken.alias("taken"), "parts")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def _cut(columns: list[str], parts_name: str, schema: pa.Schema):
    """The taken words of each text, once or twice: the whole text if all are taken."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            words, raw = Words(data, offsets, ASCII_SPACE), data.tobytes()
            index, texts = [], []
            for i, parts in enumerate(batch[parts_name].to_pylist()):
                low, high = words.bound[i], words.bound[i + 1]
                for copy in range(1, REPEATS + 1):
                    own: list[list[int]] = []
                    for p in parts:
                        if p["times"] >= copy:
                            if own and own[-1][1] == p["start"]:
                                own[-1][1] = p["end"]
                            else:
                                own.append([p["start"], p["end"]])
                    if own == [[0, high - low]]:
                        index.append(i)
                        texts.append(raw[offsets[i] : offsets[i + 1]].decode())
                    elif own:
                        index.append(i)
                        texts.append("\n".join(raw[words.start[low + a] : words.end[low + b - 1]].decode() for a, b in own))
            made = {c: batch[c].take(pa.array(index, pa.int64())) for c in columns}
            made["text"] = pa.array(texts, pa.string())
            if "n_chars" in made:
                made["n_chars"] = pa.array([len(t) for t in texts]).cast(schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], schema=schema)

    return run


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with the taken words (n_chars follows the text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = docs.columns
    id_, th, n, parts = absent(docs, "_id", "_th", "_n", "_parts")
    key = Window.partitionBy(id_, th).orderBy(id_)
    plan = mix_plan(docs).select(F.coalesce("doc_id", F.lit(MAX_ID)).alias(id_), F.col("th").alias(th), F.col("parts").alias(parts))
    plan = plan.withColumn(n, F.row_number().over(key)).where(F.size(parts) > 0)
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = rows.withColumn(n, F.row_number().over(key)).join(plan, [id_, th, n])
    schema = docs.select(*columns).schema
    return rows.select(*columns, parts).mapInArrow(_cut(columns, parts, to_arrow_schema(schema)), schema)
