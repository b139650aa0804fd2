"""Fuzzy line deduplication with DataFrame functions alone.

Lines are normalised and named by a hash. A line's SimHash has 128 bits in eight blocks, and each block has its own words: a word's hash says
to which block it belongs, and the majority of the hash bits of a block's words makes its 16 bits. So an edit of a word changes two blocks
at most and leaves the others whole, where it would turn some bits of every block of a SimHash over all words. By the pigeonhole principle a few
edits leave some block alike; in lines with fewer words, whose blocks tell little, two blocks together (a quarter) or two quarters. These are
the keys on which lines are joined, by a hash of the counters behind their bits. In lines of very few words every word is a block of its own: the keys are the
line without one of its words.

In each bucket of a key the smallest line (the leader) is compared with all others, by length and SimHash distance and then by edit distance; where
several groups are left, further leaders from outside the largest group follow, and lines that are still in different groups after that are compared with each other. So a bucket of very many variants of one line costs work in
proportion to its size, and no link between groups is lost. Of each connected group the first occurrence stays.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, absent, prepare, saved, table
from .components import components

#: SimHash bits that may differ, and the least edit similarity: 1 - distance / longer length.
MAX_DISTANCE, SIMILARITY = 48, 0.8
#: Words of fewer bytes have no weight, unless a line has no others.
LONG_WORD = 4
#: Blocks and quarters with so many words are keys; smaller quarters in pairs that have so many together.
SINGLE, PAIR = 4, 3
#: Lines of up to so many words have keys of all their words but one; those of at least so many have blocks.
FEW, ENOUGH = 11, 8
#: Words that counters of eight bits take; longer lines are counted block by block.
MOST_PACKED = 127
BLOCKS, BITS = 8, 16
#: Shifts beyond the difference in words that texts are put on each other with, and more than any text's length.
BAND, FAR = 2, 500_000_000
#: Leaders of a bucket, one after another, before the members that are left meet each other.
LEADERS = 3
#: ASCII characters but letters, digits and the end of a line, one by one: Java looks these up in a table, but compares a character with each range.
_MARKS = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum() and chr(i) != "\n")


def normal(text: Column) -> Column:
    """Lower case; runs of ASCII characters other than letters, digits and ends of lines are one space."""
    return F.regexp_replace(F.lower(text), f"[{_MARKS}]++", " ")


def _words(lines: DataFrame) -> DataFrame:
    """Of rows (seq, name, size, few, words): seq, name, size and h, the hash of each word that has weight; its last three bits are its block."""
    each = lines.select("seq", "name", "size", "few", F.explode("words").alias("w")).where((F.octet_length("w") >= LONG_WORD) | F.col("few"))
    return each.select("seq", "name", "size", F.xxhash64("w").alias("h"))


def _bit(k: int) -> str:
    return f"shiftright(shiftleft(h, {63 - 8 - k}), 63)"  # all ones or all zeros


def _in_parts(c: str) -> Column:
    """Column c. Its lambda keeps a projection out of whole-stage code, whose one method would have more than the 8,000 bytes that the JVM compiles; it's made in small methods then."""
    return F.element_at(F.transform(F.array(c), lambda x: x), 1).alias(c)


def packed_simhashes(lines: DataFrame) -> DataFrame:
    """Of rows (seq, name, size, few, words), seq being a row's own number and no row having more than MOST_PACKED words: name, size, even and odd (the
    SimHash's blocks 0, 2, 4, 6 and 1, 3, 5, 7, 16 bits each), n (words of each block, 8 bits each), and k0 to k7, a hash of each block's counters.

    Bit k of a block is set if it is in more than half of the hashes of the block's words. Words are counted as rows in longs of eight counters; their partial
    sums are one row for each line before anything is shuffled.
    """
    each = _words(lines).withColumn("u", F.expr("shiftleft(1L, cast((h & 7L) * 8 as int))"))
    sums = [F.sum(F.expr(f"{_bit(k)} & u")).alias(f"s{k}") for k in range(BITS)]
    found = each.groupBy("seq", "name", "size").agg(F.sum("u").alias("n"), *sums)
    found = found.select("name", "size", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", *(f"s{k}" for k in range(BITS)))])
    # In fields of 16 bits: 256 + count - (n - count) - 1 has bit 8 set if more than half have the bit.
    field = lambda c, odd: f"(shiftrightunsigned({c}, {8 * odd}) & 71777214294589695L)"
    more = lambda k, odd: f"(({field(f's{k}', odd)} + 72058693566333184L - ({field('n', odd)} - {field(f's{k}', odd)}) - 281479271743489L) & 72058693566333184L)"
    half = lambda odd: F.expr(" | ".join(f"{'shiftrightunsigned' if k < 8 else 'shiftleft'}({more(k, odd)}, {abs(k - 8)})" for k in range(BITS)))
    count = lambda of, c: f"shiftrightunsigned({of}, {8 * c}) & 255L"
    keys = [F.expr(f"xxhash64({c}, {', '.join(count(x, c) for x in ['n', *(f's{k}' for k in range(BITS))])})").alias(f"k{c}") for c in range(BLOCKS)]
    return found.select("name", "size", half(0).alias("even"), half(1).alias("odd"), _in_parts("n"), *keys)


def simhashes(lines: DataFrame) -> DataFrame:
    """What packed_simhashes() gives, for rows with any number of words (n counts 127 words of a block at most): a row for each block, and then one for each line."""
    sums = [F.sum(F.expr(f"{_bit(k)} & 1L")).alias(f"s{k}") for k in range(BITS)]
    found = _words(lines).groupBy("seq", "name", "size", F.expr("cast(h & 7L as int)").alias("block")).agg(F.count("*").alias("n"), *sums)
    bits = " | ".join(f"if(2 * s{k} > n, {1 << k}L, 0L)" for k in range(BITS))
    key = F.expr(f"xxhash64(block, n, {', '.join(f's{k}' for k in range(BITS))})")
    found = found.select("seq", "name", "size", "block", F.expr(f"least(n, {MOST_PACKED})").alias("n"), F.expr(bits).alias("bits"), key.alias("key"))
    half = lambda odd: F.bit_or(F.expr(f"if(block % 2 = {odd}, shiftleft(bits, cast(8 * (block - {odd}) as int)), 0L)"))
    none = [F.expr(f"xxhash64({c}, {', '.join(['0L'] * (BITS + 1))})") for c in range(BLOCKS)]
    keys = [F.coalesce(F.max(F.when(F.col("block") == c, F.col("key"))), none[c]).alias(f"k{c}") for c in range(BLOCKS)]
    return found.groupBy("seq", "name", "size").agg(half(0).alias("even"), half(1).alias("odd"), F.sum(F.expr("shiftleft(n, 8 * block)")).alias("n"), *keys).drop("seq")


def occurrences(docs: DataFrame) -> DataFrame:
    """The lines of docs (doc_id, text) with letters or digits: row (a number for each row of docs), id, th, place, normal, its words' number, and name, a hash of normal."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("id"), F.col("text"))
    rows = rows.where("text is not null").withColumn("th", F.xxhash64("text"))
    # All lines of a text are made normal at once; one without letters and digits is empty after trim().
    lines = rows.select("row", "id", "th", F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("place", "line"))
    lines = lines.select("row", "id", "th", "place", F.trim("line").alias("normal")).where("normal <> ''")
    spaces = F.octet_length("normal") - F.octet_length(F.replace("normal", F.lit(" "), F.lit("")))
    return lines.withColumns({"name": F.xxhash64("normal"), "words": (spaces + 1).cast("int")})


def keyed_lines(found: DataFrame) -> DataFrame:
    """name, size (characters), even and odd (as simhashes() gives them) and the keys (null: none) of each line of enough words that occurrences() found."""

    def own(wanted: Column) -> DataFrame:
        few = ~F.col("normal").rlike(f"[^ ]{{{LONG_WORD}}}|[^ \\x00-\\x7F]")
        return found.where(wanted).select(F.monotonically_increasing_id().alias("seq"), "name", F.length("normal").alias("size"), few.alias("few"), F.split("normal", " ").alias("words"))

    out = packed_simhashes(own(F.col("words").between(ENOUGH, MOST_PACKED))).unionByName(simhashes(own(F.col("words") > MOST_PACKED)))
    n = [f"(shiftrightunsigned(n, {8 * c}) & 255L)" for c in range(BLOCKS)]
    small = [f"{n[2 * q]} < {SINGLE} and {n[2 * q + 1]} < {SINGLE}" for q in range(4)]
    whole = [f"({n[2 * q]} + {n[2 * q + 1]})" for q in range(4)]
    each = [f"if({n[c]} >= {SINGLE}, k{c}, null)" for c in range(BLOCKS)]
    each += [f"if({small[q]} and {whole[q]} >= {SINGLE}, xxhash64(k{2 * q}, k{2 * q + 1}), null)" for q in range(4)]
    pair = lambda p, q: f"{whole[p]} < {SINGLE} and {whole[q]} < {SINGLE} and {whole[p]} + {whole[q]} >= {PAIR}"
    each += [f"if({pair(p, q)}, xxhash64({', '.join(f'k{c}' for c in (2 * p, 2 * p + 1, 2 * q, 2 * q + 1))}), null)" for p, q in combinations(range(4), 2)]
    return out.select("name", "size", "even", "odd", *[F.expr(e).alias(f"key{i}") for i, e in enumerate(each)])


def keys(lines: DataFrame) -> DataFrame:
    """A row (key, name) for each key of each line of keyed_lines()."""
    return lines.select(F.explode(F.array(*[c for c in lines.columns if c.startswith("key")])).alias("key"), "name").where("key is not null")


def few_keys(found: DataFrame) -> DataFrame:
    """A row (key, name, size) for each distinct line of few words and each of its words: all the others, in any order; and one for all words."""
    own = found.where(F.col("words") <= FEW).select("name", "normal").dropDuplicates(["name"])
    hashes = F.transform(F.split("normal", " "), lambda w: F.shiftright(F.xxhash64(w), 5))  # so that their sum is no overflow
    own = own.select("name", F.length("normal").alias("size"), hashes.alias("h"))
    total = own.withColumn("total", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x))
    left = F.array_distinct(F.concat(F.array("total"), F.transform("h", lambda x: F.col("total") - x)))
    return total.select("name", "size", F.explode(left).alias("left")).where("left <> 0").select(F.xxhash64(F.lit(99), "left").alias("key"), "name", "size")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of different texts, those that are similar enough.

    Put word on word, the texts' words that differ bound the edit distance from above: if that is enough, nothing more is computed. If not, the same is tried with the
    first words put on each other up to some place and the last ones from there, as words left out or added shift what follows; and then with a band of shifts, between
    which each word chooses (as in an edit distance of words with their lengths as costs). Of the other pairs, what both texts begin and end with alike doesn't change their distance, which is at most the length of the longer rest: only if that isn't enough, the distance
    of the rests is computed. All this is one condition on the joined texts: its steps pass their values on through arrays of one element, as each step of a
    chain of columns would be computed anew wherever a later one names it, and writing the steps down would take the texts' room several times over.
    """
    with_a = pairs.join(texts.select(F.col("name").alias("a"), F.col("normal").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("name").alias("b"), F.col("normal").alias("tb")), "b")
    most = f"cast(floor((1 - {similarity}D) * greatest(length(ta), length(tb)) + 1e-9D) as int)"
    # A word beyond the other text's end goes with the space before it.
    apart = "aggregate(zip_with(split(ta, ' '), split(tb, ' '), (x, y) -> if(x <=> y, 0, greatest(length(x), length(y)) + if(x is null or y is null, 1, 0))), 0, (n, d) -> n + d)"
    # n words are put on words, k words of the longer text on none; s is the bound so far if all words were put from the start, t if some were put from the end.
    words = "transform(array(struct(split(ta, ' ') as wa, split(tb, ' ') as wb)), p -> struct(p.wa as wa, p.wb as wb, least(size(p.wa), size(p.wb)) as n, abs(size(p.wa) - size(p.wb)) as k))"
    cost = lambda start: f"zip_with(slice(p.wa, {start.format('p.wa')}, p.n), slice(p.wb, {start.format('p.wb')}, p.n), (x, y) -> if(x = y, 0, greatest(length(x), length(y))))"
    steps = f"zip_with({cost('1')}, {cost('size({}) - p.n + 1')}, (l, r) -> struct(l, r))"
    left = "p.k * (array_max(transform(if(size(p.wa) > size(p.wb), p.wa, p.wb), x -> length(x))) + 1)"
    put = f"aggregate({steps}, struct(0 as s, 0 as t), (z, x) -> struct(z.s + x.l as s, least(z.s, z.t) + x.r as t), z -> least(z.s, z.t))"
    shifted = f"exists({words}, p -> {left} <= {most} and {put} + {left} <= {most})"
    # v holds the bounds by shift, one place for each from -BAND to BAND beyond the k words that wb has more, and a place that nothing reaches at each end; x is the i-th of wa.
    sides = [f"struct(split({c}, ' ') as wa, split({d}, ' ') as wb)" for c, d in (("ta", "tb"), ("tb", "ta"))]
    sides = f"transform(array(if(size(split(ta, ' ')) <= size(split(tb, ' ')), {sides[0]}, {sides[1]})), p -> struct(p.wa as wa, p.wb as wb, size(p.wb) - size(p.wa) as k))"
    other, before = (f"get(p.wb, z.i + j - {BAND + n})" for n in (1, 2))
    change = f"if(greatest(length(x), length({other})) > 40, greatest(length(x), length({other})), levenshtein(x, {other}))"
    put_on = f"least(u, z.v[j - 1] + coalesce(length({before}) + 1, {FAR})) + case when {other} is null then {FAR} when {other} = x then 0 else {change} end"
    bound = f"if(j = 0 or j = p.k + {2 * BAND + 2}, {FAR}, least({FAR}, {put_on}, z.v[j + 1] + length(x) + 1))"
    step = f"(z, x) -> struct(transform(z.v, (u, j) -> {bound}) as v, z.i + 1 as i)"
    end = f"z -> array_min(transform(slice(z.v, 2, p.k + {BAND + 1}), (u, j) -> u + (p.k + {BAND} - j) * (array_max(transform(p.wb, x -> length(x))) + 1)))"
    begin = f"struct(transform(sequence(0, p.k + {2 * BAND + 2}), j -> if(j = {BAND + 1}, 0, {FAR})) as v, 0 as i)"
    banded = f"exists({sides}, p -> p.k <= 4 + size(p.wa) / 8 and aggregate(p.wa, {begin}, {step}, {end}) <= {most})"
    rests = f"array(struct(ta, tb, {most} as most))"
    for _ in range(2):  # from the start, then from the end
        first = "cast(array_position(zip_with(split(p.ta, ''), split(p.tb, ''), (x, y) -> x <=> y), false) as int)"
        rests = f"transform({rests}, p -> struct(p.ta as ta, p.tb as tb, p.most as most, {first} as first))"
        rest = lambda c: f"reverse(if(p.first > 0, substring(p.{c}, p.first, length(p.{c})), '')) as {c}"
        rests = f"transform({rests}, p -> struct({rest('ta')}, {rest('tb')}, p.most as most))"
    near = f"exists({rests}, p -> greatest(length(p.ta), length(p.tb)) <= p.most or levenshtein(p.ta, p.tb, p.most) >= 0)"
    return both.where(f"abs(length(ta) - length(tb)) <= {most} and ({apart} <= {most} or {shifted} or {banded} or {near})").select("a", "b")


def _alike(max_distance: int, similarity: float) -> Column:
    """Whether the lengths and SimHashes (where both have one) of a pair (sizea, evena, odda, sizeb, evenb, oddb) allow the wanted similarity."""
    fits = F.least("sizea", "sizeb") >= similarity * F.greatest("sizea", "sizeb") - 1e-9
    apart = F.bit_count(F.col("evena").bitwiseXOR(F.col("evenb"))) + F.bit_count(F.col("odda").bitwiseXOR(F.col("oddb")))
    return fits & F.coalesce(apart <= max_distance, F.lit(True))


def _side(lines: DataFrame, c: str) -> DataFrame:
    return lines.select(F.col("name").alias(c), *[F.col(x).alias(x + c) for x in ("size", "even", "odd")])


def _compared(pairs: DataFrame, lines: DataFrame, max_distance: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose lengths and SimHashes allow the wanted similarity."""
    return pairs.join(_side(lines, "a"), "a").join(_side(lines, "b"), "b").where(_alike(max_distance, similarity)).select("a", "b")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (name, root) after links (a, b): groups that they connect become one, and only their roots take part."""
    root_of = lambda c: roots.select(F.col("name").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(ends, native=True).toDF("old", "new")
    merged = roots.join(joined, F.col("root") == F.col("old"), "left").select("name", F.coalesce("new", "root").alias("root"))
    single = joined.join(roots.select(F.col("root").alias("old")).distinct(), "old", "left_anti").select(F.col("old").alias("name"), F.col("new").alias("root"))
    return merged.unionByName(single)


def _several(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Of members (key, name), those in buckets that hold several groups: key, name, root, and main, the bucket's largest group."""
    placed = members.join(roots, "name", "left").select("key", "name", F.coalesce("root", "name").alias("root"))
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups"))
    return placed.join(groups.where("groups > 1").select("key", F.col("most.root").alias("main")), "key")


def line_groups(found: DataFrame, max_distance: int = MAX_DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """Of a table that occurrences() made: (name, root) of each line that is linked with another."""
    lines = saved(keyed_lines(found))  # equal lines stand here as often as in found
    few = saved(few_keys(found))
    each = keys(lines).unionByName(few.select("key", "name"))
    buckets = each.groupBy("key").agg(F.min("name").alias("leader"), F.max("name").alias("last"), F.count("*").alias("n")).where("leader <> last")
    shared = saved(each.join(buckets.drop("last"), "key").distinct())
    known = shared.select("name").distinct()
    blocks = lines.select("name", "size", "even", "odd").join(known, "name", "left_semi").groupBy("name").agg(*[F.min(c).alias(c) for c in ("size", "even", "odd")])
    others = few.select("name", "size").join(known, "name", "left_semi").distinct().join(blocks, "name", "left_anti")
    lines = saved(blocks.unionByName(others.withColumns({"even": F.lit(None).cast("long"), "odd": F.lit(None).cast("long")})))

    stars = shared.where("leader <> name").select(F.col("leader").alias("a"), F.col("name").alias("b")).distinct()
    stars = saved(_compared(stars, lines, max_distance, similarity))
    many = shared.where("n > 2")
    texts = saved(found.select("name", "normal").join(known, "name").dropDuplicates(["name"]))
    links = saved(_verified(stars, texts, similarity))
    roots = saved(components(links, native=True).withColumnRenamed("node", "name"))

    # In buckets that still hold several groups another leader, from outside the largest group, meets all members of other groups, and again; a leader has met all then.
    members = many.where("name <> leader").select("key", "name")
    for _ in range(LEADERS - 1):
        several = saved(_several(members, roots))
        if several.isEmpty():
            return roots
        leaders = several.where("root <> main").groupBy("key").agg(F.min(F.struct("name", "root")).alias("leader"))
        met = several.join(leaders, "key")
        pairs = met.where("root <> leader.root").select(F.least("name", "leader.name").alias("a"), F.greatest("name", "leader.name").alias("b")).distinct()
        links = saved(_verified(saved(_compared(pairs, lines, max_distance, similarity)), texts, similarity))
        members = met.where("name <> leader.name").select("key", "name")
        roots = saved(_grown(roots, links)) if not links.isEmpty() else roots

    # What is still outside its bucket's largest group meets all members of other groups; a pair that can't be similar is no row.
    several = _several(members, roots)
    side = lambda c: _side(lines, c).join(several.select("key", F.col("name").alias(c), F.col("root").alias(f"r{c}"), "main"), c)
    outside = side("a").where("ra <> main").drop("main")
    cross = outside.join(side("b").drop("main"), "key").where("ra <> rb").where(_alike(max_distance, similarity))
    cross = saved(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = saved(_verified(cross, texts, similarity))
    return _grown(roots, more)


def dedup_lines(docs: DataFrame, max_distance: int = MAX_DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """Which lines of docs (doc_id, text) go: one row for each text with words (rows equal in both columns share one), id, th, n_lines,
    removed (places of the lines that go, from 0).

    Two lines are linked if their normal forms are equal, or if they share a key, their SimHashes differ in max_distance of 128 bits at most and their edit
    similarity is similarity or more. (A word edited or replaced always leaves a key that both lines have, as long as the other words leave one; several edits mostly
    do.) Of the lines that links connect, the first by doc_id (null last), text hash and place stays. Lines
    without letters and digits aren't compared and always stay; texts that are null or have no other lines give no row. Lines are
    named by 64-bit hashes. Other columns are ignored. No rows give no rows.
    """
    prepare(docs.sparkSession)
    found = saved(occurrences(docs))
    roots = line_groups(found, max_distance, similarity)
    slim = found.select("id", "th", "place", "name").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    first = slim.groupBy("root").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = slim.join(first, "root").where(F.struct("id", "th", "place") != F.col("first"))
    removed = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("place")).alias("removed"))
    counts = found.groupBy("row", "id", "th").agg(F.count("*").alias("n_lines")).groupBy("id", "th").agg(F.max("n_lines").alias("n_lines"))
    return counts.join(removed, ["id", "th"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def with_lines_removed(docs: DataFrame, **options) -> DataFrame:
    """docs and new columns n_lines (lines with words), n_removed and kept_text: the text without the lines that dedup_lines() removes."""
    id_, th, gone, lines = absent(docs, "_id", "_th", "_gone", "_lines")
    found = dedup_lines(docs, **options).select(F.col("id").alias(id_), F.col("th").alias(th), F.col("n_lines").alias(lines), F.col("removed").alias(gone))
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)), th: F.xxhash64("text")})
    kept = F.expr(f"array_join(transform(filter(transform(split(text, '\\n', -1), (l, i) -> struct(l, i)), p -> not array_contains({gone}, p.i)), p -> p.l), '\\n')")
    out = rows.join(found, [id_, th], "left")
    removed = F.coalesce(F.size(gone), F.lit(0))
    return out.withColumns({"n_lines": F.coalesce(lines, F.lit(0)), "n_removed": removed.cast("long"), "kept_text": F.when(removed > 0, kept).otherwise(F.col("text"))}).drop(id_, th, gone, lines)


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (places of the lines that go, joined by commas)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dedup_lines(docs).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "n_lines", "removed")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    out = rows.join(gone, ["_id", "_th"], "left")
    places = F.coalesce(F.array_join(F.transform("removed", lambda p: p.cast("string")), ","), F.lit(""))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), places.alias("removed"))
