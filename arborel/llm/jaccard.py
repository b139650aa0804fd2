"""Exact n-gram Jaccard self-join and its connected groups, with set-relation skipping.

1. Every text becomes its set of distinct word shingles; texts with equal sets are one *class*.
2. All shingles are counted in a table of fixed size, which gives a global order, rare first. Sets whose
   Jaccard similarity reaches t share a shingle among the first n - ceil(t n) + 1 of each, so only these
   go to the inverted index (with their position), in buckets of bounded size; a common shingle's list is dealt to several.
3. Index-level skipping: a list is sorted by set size and cut into blocks whose sizes can match; sizes and
   positions bound the overlap of a pair, which is skipped if the bound is too low.
4. Answer-level skipping: in each block only one set (the leader, by one of a few fixed orders) meets all others.
   A set whose similarity with the leader is verified shares the leader's group, so its pairs with the group need no work. Pairs that the
   first round leaves in different groups are all examined in the second round: those whose bitmaps differ in too many bits are
   skipped, the answers for a set are derived from the computed ones of the set most like it (what they don't share bounds the difference), and
   only pairs that this leaves open are compared by their texts. Thus no link between groups is
   lost, and a group of copies costs work in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, Packer, Words, absent, by_bucket, id_text, in_arrow, mix, pieces, prepare, saved, segments, shingle_sets, table, unpack
from .components import components

#: Cells of the table of counts; its size (4 MB of bytes to broadcast) doesn't grow with the input.
CELL_BITS = 22
#: Cells go to the driver in this many ranges.
RANGES = 16
#: Tasks whose counts are added in one.
FAN = 64
#: A task's cells with fewer hits are left out of the order's counts (as in lossy counting).
LEAST_HITS = 3
#: Postings in a bucket of the index, about.
BUCKET_ROWS = 300_000
#: A cell with so many times the mean count holds common shingles, whose lists are dealt to several buckets.
HOT = 64
#: Members of a list or partners of a leader that are worked on together.
BLOCK = 2048

#: Orders by which lists choose leaders: about as many leaders serve a group of similar sets.
ORDERS = 8
#: Bits of the parity map of a set; two maps differ in no more bits than their sets in shingles.
MAP_BITS = 1024

_CELLS_OF = np.dtype([("cell", "<u4"), ("count", "<u8")])
_POSTING = [("name", "<u8"), ("key", "<u8"), ("n", "<u4"), ("pos", "<u4")]


def _set_key(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) + np.uint64(len(s)))[0])


def _cells(counts: np.ndarray) -> bytes:
    """The cells that have a count, with it."""
    at = np.flatnonzero(counts)
    out = np.empty(len(at), _CELLS_OF)
    out["cell"], out["count"] = at, counts[at]
    return out.tobytes()


def _classes(k: int):
    """Rows (id, th, n, key) of all texts; and the counts of this task's cells, as rows with a range."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("range", pa.int32()), ("cells", pa.binary())])

    def run(batches):
        counts, seen = np.zeros(1 << CELL_BITS, np.uint32), set()
        for rows, data, offsets in pieces(batches):
            sets = shingle_sets(Words(data, offsets), k)
            keys = [_set_key(s) if len(s) else 0 for s in sets]
            fresh = []
            for s, key in zip(sets, keys, strict=True):
                if key not in seen:
                    seen.add(key)
                    fresh.append(s)
            if fresh:
                np.add.at(counts, (np.concatenate(fresh) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            if len(seen) > 1_000_000:
                seen.clear()
            n = rows.num_rows
            key = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows["id"], rows["th"], pa.array([len(s) for s in sets], pa.int64()), key, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        size = (1 << CELL_BITS) // RANGES
        blobs = []
        for r in range(RANGES):
            own = counts[r * size : (r + 1) * size]
            blobs.append(_cells(np.where(own >= LEAST_HITS, own, 0)))
        nothing = pa.nulls(RANGES, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(range(RANGES), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return run, "id long, th long, n long, key long, range int, cells binary"


def _order(found: DataFrame) -> np.ndarray:
    """The rank of each cell by its total count, a byte for each: 4 log2(1 + count). Counts are added in a tree, so that no task reads from all others."""
    size = (1 << CELL_BITS) // RANGES

    def add(last: bool):
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for r, cells in zip(batch["range"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                    cell, count = np.frombuffer(cells, _CELLS_OF)["cell"], np.frombuffer(cells, _CELLS_OF)["count"]
                    total.setdefault(r, np.zeros(size, np.uint64))[cell] += count  # a cell stands once in a row
            for r, t in total.items():
                out = np.round(4 * np.log2(1.0 + t)).astype(np.uint8).tobytes() if last else _cells(t)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([out], pa.binary())], names=["range", "cells"])

        return run

    parts = found.where("range is not null").select("range", "cells")
    tasks = parts.where("range = 0").count()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = in_arrow(parts.withColumn("group", F.pmod(F.xxhash64("cells"), F.lit(tasks))).repartition(RANGES * tasks, "range", "group").select("range", "cells"), add(False), "range int, cells binary")
    parts = in_arrow(parts.repartition(RANGES, "range"), add(True), "range int, ranks binary")
    order = np.zeros((RANGES, size), np.uint8)
    for r, ranks in parts.collect():  # one row for each range: 4 MB in all, whatever the input
        order[r] = np.frombuffer(ranks, np.uint8)
    return order.reshape(-1)


def _parts(shingles: int) -> np.ndarray:
    """In how many parts lists are dealt, by the rank of their cell: more than one if the cell's count is beyond a bucket and far beyond the mean cell's."""
    counts = 2 ** (np.arange(256) / 4)
    hot = counts > max(BUCKET_ROWS, HOT * shingles / (1 << CELL_BITS))
    return np.where(hot, np.ceil(counts / BUCKET_ROWS), 1).astype(np.uint64)


def _postings(k: int, percent: int, order, buckets: int, parts: np.ndarray):
    def deal(rows):
        own = parts[(rows["name"] >> np.uint64(56)).astype(np.int64)]
        return mix(rows["name"] + mix(rows["key"]) % own)

    def run(batches):
        rank, seen = order.value, set()
        packer = Packer(_POSTING, buckets, deal=deal)
        for _, data, offsets in pieces(batches):
            names, keys, sizes, places = [], [], [], []
            for s in shingle_sets(Words(data, offsets), k):
                n = len(s)
                if not n or (key := _set_key(s)) in seen:
                    continue
                seen.add(key)
                p = n - -(-percent * n // 100) + 1
                s = (s >> np.uint64(8)) | (rank[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56))
                if p < n:
                    s = np.partition(s, p - 1)[:p]
                s.sort()
                names.append(s)
                keys.append(key)
                sizes.append(n)
                places.append(len(s))
            if len(seen) > 1_000_000:
                seen.clear()
            if names:
                each = np.array(places)
                pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield from packer.add(name=np.concatenate(names), key=np.repeat(np.array(keys, np.uint64), each), n=np.repeat(sizes, each), pos=pos)
        yield from packer.flush()

    return run


def _can_match(n1, p1, n2, p2, percent: int):
    """Whether the sizes and the places of a common shingle allow the wanted similarity."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))
    least = -(-percent * (n1 + n2) // (100 + percent))
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (most >= least) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = segments(a, b)[:-1]
    return a[keep], b[keep]


def _stars(name, key, n, pos, percent: int):
    """Of postings sorted by name, size and key: each row's leader, as a place, and the pairs of a leader and a member that can match."""
    edge = segments(name)
    size = np.diff(edge)
    if not len(name):
        return np.zeros(0, np.int64), key, key
    # Blocks: from a list's first set on, or from the first that is too large for the block before.
    start, at = np.repeat(edge[:-1], size), np.arange(len(name))
    while (far := 100 * n[start].astype(np.int64) < percent * n.astype(np.int64)).any():
        nearest = np.minimum.reduceat(np.where(far, at, len(name)), edge[:-1])
        start = np.where(far, np.repeat(nearest, size), start)
    block = segments(start)
    rank = mix(key ^ (name % np.uint64(ORDERS)) * np.uint64(0x9E3779B97F4A7C15))
    lowest = np.repeat(np.minimum.reduceat(rank, block[:-1]), np.diff(block))
    leader = np.repeat(np.minimum.reduceat(np.where(rank == lowest, at, len(name)), block[:-1]), np.diff(block))
    pair = (leader != at) & _can_match(n[leader], pos[leader], n, pos, percent)
    return leader, *_distinct_pairs(key[leader[pair]], key[pair])


_LISTS = "name long, a long, b long, n int, pos int"


def _rows(name, a, b, n, pos) -> pa.RecordBatch:
    signed = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64))
    small = lambda x: pa.nulls(len(a), pa.int32()) if x is None else pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([signed(name), signed(a), signed(b), small(n), small(pos)], names=["name", "a", "b", "n", "pos"])


def _lists(percent: int, parts: np.ndarray):
    """Of a bucket: candidate pairs (leader, member); with their names, the lists of three sets and more; and the leaders of lists that are dealt out, once more, with b = a."""

    def work(blocks):
        c = unpack(blocks, _POSTING)
        order = np.argsort(c["name"], kind="stable")
        edge = segments(c["name"][order])
        size = np.diff(edge)
        many = parts[(c["name"][order] >> np.uint64(56)).astype(np.int64)] > 1
        order = order[many | np.repeat(size > 1, size)]
        name, key, n, pos = (c[x][order] for x in ("name", "key", "n", "pos"))
        order = np.lexsort((key, n, name))
        order = order[segments(name[order], key[order])[:-1]]
        name, key, n, pos = (x[order] for x in (name, key, n, pos))
        leader, a, b = _stars(name, key, n, pos, percent)
        size = np.diff(segments(name))
        many = parts[(name >> np.uint64(56)).astype(np.int64)] > 1
        more = many | np.repeat(size > 2, size)
        head = np.unique(leader[many])
        return pa.Table.from_batches(
            [
                _rows(None, a, b, None, None),
                _rows(name[more], key[more], None, n[more], pos[more]),
                _rows(name[head], key[head], key[head], n[head], pos[head]),
            ]
        )

    return work


def _heads(percent: int):
    """Candidate pairs among the leaders of the parts of one list."""

    def work(group: pa.Table) -> pa.Table:
        name, key = (group[c].to_numpy().view(np.uint64) for c in ("name", "a"))
        n, pos = (group[c].to_numpy() for c in ("n", "pos"))
        order = np.lexsort((key, n))
        order = order[segments(key[order])[:-1]]
        _, a, b = _stars(*(x[order] for x in (name, key, n, pos)), percent)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return work


def _cross(percent: int, best: bool):
    """Of sorted rows: the pairs of a list's outsiders (role 0) and members (role 1) that are in different groups and can match. best: of each outsider and group the
    likeliest pair alone."""
    names = ("name", "x", "y", "role", "root", "key", "n", "pos", "outside")

    def pairs(rows: list[dict[str, np.ndarray]]):
        c = {k: np.concatenate([r[k] for r in rows]) for k in rows[0]}
        out_a, out_b = [], []
        for low, high in zip((e := segments(c["name"], c["x"], c["y"]))[:-1], e[1:], strict=True):
            own = {k: v[low:high] for k, v in c.items()}
            first = int(np.searchsorted(own["role"], 1))
            sizes = own["n"][first:]  # ascending
            for i in range(first):
                n = int(own["n"][i])
                j = first + np.arange(np.searchsorted(sizes, -(-percent * n // 100)), np.searchsorted(sizes, 100 * n // percent, "right"))
                j = j[(own["root"][j] != own["root"][i]) & ~(own["outside"][j] & (own["key"][j] < own["key"][i]))]  # two outsiders meet once
                j = j[_can_match(own["n"][j], own["pos"][j], own["n"][i : i + 1], own["pos"][i : i + 1], percent)]
                if len(j):
                    total = own["n"][j].astype(np.int64) + n
                    apart = np.bitwise_count(own["map"][j] ^ own["map"][i]).sum(axis=1, dtype=np.int64)
                    can = apart <= total - 2 * -(-percent * total // (100 + percent))
                    j, far = j[can], (apart / total)[can]
                    if best:
                        order = np.lexsort((far, own["root"][j]))
                        j = j[order[segments(own["root"][j][order])[:-1]]]
                out_a.append(np.full(len(j), own["key"][i]))
                out_b.append(own["key"][j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        a, b = _distinct_pairs(np.minimum(a, b), np.maximum(a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            own = {k: batch[k].to_numpy(zero_copy_only=False) for k in names}
            if not batch.num_rows:
                continue
            own["map"] = np.frombuffer(b"".join(batch["map"].to_pylist()), "<u8").reshape(batch.num_rows, -1)
            cut = 0
            if n > 100_000:  # a list and pair of blocks is at most 2 * BLOCK rows, give or take
                last = held[-1]
                same = (own["name"] == last["name"][-1]) & (own["x"] == last["x"][-1]) & (own["y"] == last["y"][-1])
                cut = int(np.argmin(same)) if not same.all() else batch.num_rows
                if cut < batch.num_rows:
                    held.append({k: v[:cut] for k, v in own.items()})
                    yield pairs(held)
                    held, n = [], 0
                    own = {k: v[cut:] for k, v in own.items()}
            held.append(own)
            n += len(own["name"])
        if held:
            yield pairs(held)

    return run


def _maps(k: int):
    """Texts with the parity maps of their sets."""

    def run(batches):
        for rows, data, offsets in pieces(batches):
            maps = []
            for s in shingle_sets(Words(data, offsets), k):
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([rows["key"], rows["text"], pa.array(maps, pa.binary())], names=["key", "text", "map"])

    return run


def _overlaps(k: int):
    """Of rows sorted by leader, its own row (b is null) first: the sizes of each pair's sets and of what they share."""

    def run(batches):
        leader, own = None, np.zeros(0, np.uint64)
        for rows, data, offsets in pieces(batches):
            out: list[tuple[int, int, int, int, int]] = []
            for a, b, s in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), shingle_sets(Words(data, offsets), k), strict=True):
                if b is None:
                    leader, own = a, s
                    continue
                assert a == leader
                at = np.searchsorted(own, s)
                both = int((own[np.minimum(at, len(own) - 1)] == s).sum()) if len(own) else 0
                out.append((a, b, len(own), len(s), both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["a", "b", "na", "nb", "both"])

    return run


def _met(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, na, nb, both) of pairs (a, b). A leader's text meets its partners' one after another; partners are dealt out, so many partners are many tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    member = pairs.join(parts, "a").join(texts.drop("map"), F.col("b") == F.col("key")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "text")
    lead = parts.join(texts.drop("map"), F.col("a") == F.col("key")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = lead.unionByName(member).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return in_arrow(rows.select("a", "b", "text"), _overlaps(k), "a long, b long, na long, nb long, both long")


def _is_link(both, na, nb, percent: int):
    return 100 * both >= percent * (na + nb - both)


def derived(pairs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Answers for pairs (a, b) from the computed answers `met` of sets that are linked with a or b: pairs, and link (null: open).

    If y is linked with x, and both(y, z) is known, then both(x, z) is at least both(y, z) - |y without x| and at most both(y, z) + |x without y|. Of the sets
    linked with x the one that shares most with it is asked.
    """
    ways = met.select("a", "b", "na", "nb", "both").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "both"))
    near = ways.where(_is_link(F.col("both"), F.col("na"), F.col("nb"), percent)).groupBy(F.col("a").alias("x"))
    near = near.agg(F.max(F.struct(F.expr("both / (na + nb - both)").alias("near"), F.col("b").alias("y"), F.col("na").alias("nx"), F.col("nb").alias("ny"), "both")).alias("m")).select("x", "m.y", "m.nx", "m.ny", F.col("m.both").alias("xy"))
    asked = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("z")).unionByName(pairs.select("a", "b", F.col("b").alias("x"), F.col("a").alias("z")))
    known = asked.join(near, "x").join(ways.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("nb").alias("nz"), F.col("both").alias("yz")), ["y", "z"])
    least, most = F.greatest(F.col("yz") - (F.col("ny") - F.col("xy")), F.lit(0)), F.least(F.col("yz") + F.col("nx") - F.col("xy"), "nx", "nz")
    link = F.when(_is_link(least, F.col("nx"), F.col("nz"), percent), True).when(~_is_link(most, F.col("nx"), F.col("nz"), percent), False)
    found = known.groupBy("a", "b").agg(F.max(link).alias("link"))
    return pairs.join(found, ["a", "b"], "left")


def _apart(lists: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the lists that hold several groups: the members outside a list's largest group (role 0) beside all its members (role 1), in blocks, sorted."""
    placed = lists.join(groups, F.col("key") == F.col("node"), "left").select("name", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
    size = placed.groupBy("name", "root").agg(F.count("*").alias("size"))
    open_lists = size.groupBy("name").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main")).where("size > main.size")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_lists = open_lists.select("name", F.col("main.root").alias("main"), blocks(F.col("size") - F.col("main.size")).alias("xs"), blocks(F.col("size")).alias("ys"))
    dealt = placed.join(open_lists, "name").join(texts.select("key", "map"), "key").withColumn("outside", F.col("root") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["name", "x", "y", "role", "root", "key", "n", "pos", "outside", "map"]
    outsiders = dealt.where("outside").withColumns({"x": own("xs"), "role": F.lit(0)}).withColumn("y", each("ys")).select(columns)
    everyone = dealt.withColumns({"y": own("ys"), "role": F.lit(1)}).withColumn("x", each("xs")).select(columns)
    return outsiders.unionByName(everyone).repartition("name", "x", "y").sortWithinPartitions("name", "x", "y", "role", "n", "key")


_real = lambda c: F.when(F.col(c) != MAX_ID, F.col(c))


def ngram_jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Links texts whose k-word shingle sets (A-Z lower-cased) have a Jaccard similarity of percent / 100 or more.

    Returns one row per row of docs (doc_id, text): id, th (xxhash64 of the text), n_shingles, component_id: the
    smallest doc_id that links reach. Null or empty texts, and texts without words, have n_shingles 0 and link with
    nothing. A null doc_id counts as the largest. Repeated rows stay and are linked with each other; rows that share
    a doc_id but not a text count as different texts. Shingles and sets are compared by 64-bit hashes. Other columns
    of docs are ignored. No rows give no rows.
    """
    return _groups(docs, k, percent).select(_real("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), _real("top").alias("component_id"))


def _groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """What ngram_jaccard_groups() returns, as id, th, n and top (MAX_ID for null), and root, which tells groups apart also where their ids don't; null if n is 0."""
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs).withColumn("th", F.xxhash64("text"))
    run, schema = _classes(k)
    found = saved(in_arrow(rows, run, schema))
    members = found.where("range is null")
    shingles = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = spark.sparkContext.broadcast(_order(found))
    buckets = max(1, -(-shingles * (100 - percent) // (100 * BUCKET_ROWS)))
    parts = _parts(shingles)
    index = saved(by_bucket(in_arrow(rows.select("text"), _postings(k, percent, order, buckets, parts), "bucket int, block binary"), _lists(percent, parts), _LISTS))
    heads = index.where("name is not null and a = b").groupBy("name").applyInArrow(_heads(percent), "a long, b long")
    pairs = saved(index.where("name is null").select("a", "b").unionByName(heads).distinct())
    lists = index.where("name is not null and b is null").select("name", F.col("a").alias("key"), "n", "pos")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(lists.select("key")).distinct()
    first = members.groupBy("key").agg(F.min(F.struct("id", "th")).alias("f")).join(wanted, "key").select("key", "f.id", "f.th")
    texts = rows.join(first, ["id", "th"]).dropDuplicates(["id", "th", "key"]).select("key", "text")
    texts = saved(in_arrow(texts, _maps(k), "key long, text string, map binary"))

    met = saved(_met(pairs, texts, k))
    is_link = _is_link(F.col("both"), F.col("na"), F.col("nb"), percent)
    groups = saved(components(met.where(is_link).select("a", "b")))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # First the likeliest pair of each outsider and group, which mostly joins them; then all pairs of those that are still apart.
    for best in (True, False):
        cross = saved(in_arrow(_apart(lists, groups, texts), _cross(percent, best), "a long, b long").distinct().join(done, ["a", "b"], "left_anti"))
        answers = saved(derived(cross, met, percent))
        rest = _met(answers.where("link is null").select("a", "b"), texts, k).where(is_link)
        more = saved(answers.where("link").select("a", "b").unionByName(rest.select("a", "b")))
        groups = saved(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
        done = done.unionByName(cross)

    least = members.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    placed = least.join(groups, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    tops = placed.groupBy("root").agg(F.min("least").alias("top"))
    named = placed.join(tops, "root").select("key", "top", "root")
    linked = members.where("n > 0").join(named, "key")
    alone = members.where("n = 0").withColumns({"top": F.col("id"), "root": F.lit(None).cast("long")})
    return linked.select("id", "th", "n", "top", "root").unionByName(alone.select("id", "th", "n", "top", "root"))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id of ngram_jaccard_groups()."""
    return ngram_jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of linked documents, those with the smallest doc_id (of repeated rows one); texts without words all stay."""
    id_, th = absent(docs, "_id", "_th")
    keep = _groups(docs).where("n > 0").groupBy("root").agg(F.min(F.struct("id", "th")).alias("k")).select(F.col("k.id").alias(id_), F.col("k.th").alias(th))
    wordless = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    rows = docs.where(~wordless).withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = rows.join(keep, [id_, th], "left_semi").dropDuplicates([id_, th]).select(*docs.columns)
    return kept.unionByName(docs.where(wordless))


ORACLE = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from starts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as root from texts union select r.doc_id, l.b from reach r join both_ways l on l.a = r.root),
groups as (select doc_id, min(root) as component_id from reach group by doc_id)
select g.doc_id, coalesce(s.n, 0) as n_shingles, g.component_id from groups g left join sizes s on s.doc_id = g.doc_id
"""
