"""Exact top-k search by inner product over KD-trees, one for each shard.

A tree splits its points at the median of their widest dimension and keeps the tight bounding box of every node. No point
of a box scores more than sum(max(q * low, q * high)), so a query goes through the nodes best bound first and ends where
the bound falls below the k-th best score so far. That score begins with the best among a few rows of the query block, is carried from tree to tree
of a task, and from the trees of a first round to all others. Trees are rows of a saved table; queries are too, in blocks of bounded bytes, which
every task reads one after another, so a task holds a few trees and one block whatever the input.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, prepare, saved, scratch, table, width

#: Points of a shard, about, and of a leaf at most.
SHARD_ROWS, LEAF_ROWS = 32_768, 128
#: Bytes of a query block, and rows of it that give the first k-th scores.
QUERY_BYTES, SEED_ROWS = 8 << 20, 1024
#: Share of the trees that are searched first, and trees that a task holds at most, about.
FIRST_SHARE, TASK_TREES, SEED = 0.1, 8, 3
SCALE = 256.0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of all components as exact doubles, shorter vectors filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(offsets)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(offsets[0], offsets[-1])
    out[row, at - np.repeat(offsets[:-1], size)] = values[at]
    return out


class Tree:
    """A KD-tree: node i has the points first[i] to last[i] and, unless it is a leaf, the nodes 2 i + 1 and 2 i + 2."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        spans, todo = {}, [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            spans[node] = (a, b)
            if b - a > LEAF_ROWS:
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], half)]
                todo += [(2 * node + 1, a, a + half), (2 * node + 2, a + half, b)]
        self.ids, self.points = ids[order], points[order]
        n = max(spans) + 1
        self.first, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.high = np.zeros((n, points.shape[1])), np.zeros((n, points.shape[1]))
        for node, (a, b) in spans.items():
            self.first[node], self.last[node] = a, b
            self.low[node], self.high[node] = self.points[a:b].min(axis=0), self.points[a:b].max(axis=0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.int64) for k, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in z.files:
                setattr(tree, k, z[k] if k in ("ids", "first", "last") else z[k].astype(np.float64))
        return tree

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[float, int]]], floor: np.ndarray) -> int:
        """Adds this tree's points to best, each query's heap of (score, -id); returns how many leaves were read."""
        read = 0
        for low in range(0, len(ids), 512):
            own = queries[low : low + 512]
            bounds = np.maximum(own, 0) @ self.high.T + np.minimum(own, 0) @ self.low.T
            for q in range(len(own)):
                heap, bound = best[low + q], bounds[q]
                front = [(-bound[0], 0)]
                while front:
                    top, node = heapq.heappop(front)
                    kth = heap[0][0] if len(heap) == k else floor[low + q]
                    if -top < kth:  # an equal bound may hide a tie with a smaller id
                        break
                    if self.last[node] - self.first[node] > LEAF_ROWS:
                        for child in (2 * node + 1, 2 * node + 2):
                            heapq.heappush(front, (-bound[child], child))
                        continue
                    read += 1
                    a, b = self.first[node], self.last[node]
                    scores = self.points[a:b] @ own[q]
                    for i in np.flatnonzero(scores >= kth):
                        if self.ids[a + i] != ids[low + q]:
                            entry = (scores[i], -int(self.ids[a + i]))
                            if len(heap) < k:
                                heapq.heappush(heap, entry)
                            elif entry > heap[0]:
                                heapq.heapreplace(heap, entry)
        return read


def _build(dims: int):
    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        ids, points = whole["vec_id"].to_numpy(), _matrix(whole["embedding"], dims)
        for low in range(0, len(ids), 2 * SHARD_ROWS):
            tree = Tree(ids[low : low + 2 * SHARD_ROWS], points[low : low + 2 * SHARD_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array([tree.to_bytes()], pa.binary())], names=["tree"])

    return run


def _packed(dims: int, k: int):
    """Of a block of queries: one row with their ids, vectors and first k-th scores, those among the block's first rows."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        ids, queries = group["vec_id"].to_numpy(), _matrix(group["embedding"], dims)
        scores = queries @ queries[:SEED_ROWS].T
        scores[ids[:, None] == ids[None, :SEED_ROWS]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), queries.astype("<f8"), floor.astype("<f8"))]
        return pa.table([group["block"][:1], *blobs], names=["block", "ids", "queries", "floor"])

    return work


def _blocks(folder: str) -> Iterator[dict]:
    """The rows of a table of query blocks in the shared folder, one after another."""
    from pyarrow import dataset, fs

    files, root = fs.FileSystem.from_uri(folder)
    paths = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    for batch in dataset.dataset(paths, filesystem=files, format="parquet").to_batches(batch_size=1, batch_readahead=0, fragment_readahead=0) if paths else ():
        yield from batch.to_pylist()


def _search(folder: str, k: int):
    """Every block of queries, one after another, through the trees of a task: the k-th scores go from tree to tree."""

    def run(batches):
        trees = [Tree.from_bytes(data.as_py()) for batch in batches for data in batch["tree"]]
        for row in _blocks(folder) if trees else ():
            ids, floor = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["floor"], "<f8")
            queries = np.frombuffer(row["queries"], "<f8").reshape(len(ids), -1)
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for tree in trees:
                tree.search(ids, queries, k, best, floor)
            n = [len(b) for b in best]
            flat = [e for b in best for e in b]
            columns = [np.full(len(flat), row["block"]), np.repeat(np.arange(len(ids)), n), np.repeat(ids, n), np.array([-e[1] for e in flat], np.int64), np.array([e[0] for e in flat], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "query", "query_id", "vec_id", "score"])

    return run


def _raised(group: pa.Table) -> pa.Table:
    """A block's row with the k-th scores (query, kth) found so far."""
    own = group.filter(group["ids"].is_valid())
    floor = np.frombuffer(own["floor"][0].as_py(), "<f8").copy()
    found = group.filter(group["kth"].is_valid())
    at = found["query"].to_numpy()
    floor[at] = np.maximum(floor[at], found["kth"].to_numpy())
    return own.select(["block", "ids", "queries"]).append_column("floor", pa.array([floor.tobytes()], pa.binary()))


_QUERIES = "block int, ids binary, queries binary, floor binary"


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the highest inner products with each row whose vec_id is divisible by every.

    Components count as floor(256 x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows
    if there are fewer candidates. Rows with a null vec_id, a null vector, or a null, NaN or infinite component take no part; a
    shorter vector counts as filled up with zeros. A query doesn't meet rows of its own vec_id; otherwise repeated rows are candidates and
    queries each by itself. Scores are exact while below 2**53. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, dims, n_queries = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.count_if(is_query)).first()
    shards = max(min(width(spark), -(-n // LEAF_ROWS)), -(-n // SHARD_ROWS), 1)
    trees = saved(in_arrow(rows.repartition(shards), _build(dims), "tree binary").withColumn("first", F.rand(SEED) < FIRST_SHARE))
    blocks = max(1, -(-n_queries * max(dims, 1) * 8 // QUERY_BYTES))
    asked = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    folder = scratch(spark)
    queries = saved(asked.groupBy("block").applyInArrow(_packed(dims, k), _QUERIES), folder)

    def searched(own: DataFrame, folder: str) -> DataFrame:
        tasks = min(shards, max(width(spark), -(-shards // TASK_TREES)))
        return saved(in_arrow(own.select("tree").repartition(tasks), _search(folder, k), "block long, query long, query_id long, vec_id long, score long"))

    # A few trees first: their k-th scores bound the search in all others.
    order = Window.partitionBy("block", "query", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = searched(trees.where("first"), folder)
    kth = ranked(first).where(F.col("rank") == k).select(F.col("block").cast("int").alias("block"), "query", F.col("score").cast("double").alias("kth"))
    both = queries.withColumns({"query": F.lit(None).cast("long"), "kth": F.lit(None).cast("double")}).unionByName(kth, allowMissingColumns=True)
    raised = scratch(spark)
    saved(both.groupBy("block").applyInArrow(_raised, _QUERIES), raised)
    found = first.unionByName(searched(trees.where("not first"), raised))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Five rows for each query of the embeddings: query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with parts as (
  select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings where vec_id is not null and embedding is not null),
broken as (select distinct vec_id from parts where x is null or not isfinite(x)),
ints as (select vec_id, i, cast(floor(256 * cast(x as double)) as bigint) as v from parts where vec_id not in (select vec_id from broken)),
scores as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.v * c.v) as bigint) as score
  from ints q join ints c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
