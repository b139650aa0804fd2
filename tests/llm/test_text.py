"""Operators on documents against plain Python, over tables that hold all odd cases, and over empty ones."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from arborel.llm import components, decontaminate, jaccard, lines, mixing, pii, records, repeats, toxicity
from arborel.llm.common import BATCH_ROWS, Words, pieces, shingle_sets
from arborel.llm.crc32c import crc32c, frames, masked, unframe

from . import cases


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module", params=[0, 1])
def data(request):
    return cases.rows(request.param)


def test_words_and_hashes_equal_python(data):
    import pyarrow as pa

    texts = [t for _, t, _ in data]
    for rows, raw, offsets in pieces(pa.table({"text": pa.array(texts, pa.string())}).to_batches()):
        words = Words(raw, offsets)
        got = [bytes(raw[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)]
        assert got == [w for t in rows["text"].to_pylist() for w in cases.words(t)]
        names = dict(zip(got, words.hashes().tolist(), strict=True))
        assert len(set(names.values())) == len(names)
        assert [len(s) for s in shingle_sets(words, 5)] == [len(cases.shingles(t)) for t in rows["text"].to_pylist()]
    assert BATCH_ROWS > 0


# --- token records -----------------------------------------------------------------------------------


def test_crc32c_known_values_and_frames():
    assert crc32c([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]
    rng = random.Random(1)
    items = [rng.randbytes(rng.choice([0, 1, 3, 4, 5, 255, 256, 257, 1000, 5000])) for _ in range(60)]
    assert all(crc32c([x])[0] == c for x, c in zip(items, crc32c(items), strict=True))
    whole = frames(items)
    at = np.cumsum([0] + [len(f) for f in whole[:-1]]).tolist()
    assert unframe(b"".join(whole), at) == items
    broken = bytearray(b"".join(whole))
    broken[at[5] + 12] ^= 1
    with pytest.raises(ValueError):
        unframe(bytes(broken), at)
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def direct(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary()).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_whole_texts():
    rng = random.Random(2)
    letters = "abcABC'.,.,!-09 \n\t\x0b éÉßİΣσ́日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["x<|endoftext|>y", "<|ENDOFTEXT|> it's", "don't. we'll, ok", "a.", "a.,b"]
    encoder = records.Encoder(vocabulary())
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.texts([t.encode() for t in texts], b"")] == direct(texts)


def test_token_records_round_trip(spark, data, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = records.write_token_records(cases.frame(spark, data), vocabulary(), folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.read_token_records(shards, folder).collect())
    ids = [x + [1] for x in direct([t or "" for _, t, _ in data])]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _, _), x in zip(data, ids, strict=True))
    assert Counter(g[1:] for g in got) == want
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    assert [cases.order(g[1]) for g in got] == sorted(cases.order(g[1]) for g in got)
    shard = shards.orderBy("shard").first()
    index = records.read_index(folder, shard.shard)
    order = np.random.default_rng(0).permutation(len(index))
    shuffled = records.read_records(folder, shard.shard, index[order], shard.id_bytes)
    assert [len(x) for x in shuffled] == index["n"][order].tolist() and all(x[-1] == 1 for x in shuffled)


def test_token_records_of_nothing(spark):
    assert records.token_records(cases.frame(spark, [])).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------


def toxic_tables(spark, n=400):
    draw = random.Random(3)
    bad = ["zgrumble", "zgrumpf", "vexatious", "blight", "zgrunt"]
    data = []
    for i in range(n):
        w = cases.text(draw, draw.randrange(5, 60)).split(" ")
        if i % 4 == 0:
            for b in draw.sample(bad, 3):
                w.insert(draw.randrange(len(w)), b)
        data.append((i, " ".join(w), "s"))
    extra = [(n, None, "s"), (n + 1, "", "s"), (None, "zgrumble blight vexatious", "s"), (n + 2, "!!!", "s")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(n)] + [(n, 1, None), (None, 1, 1), (n + 1, None, 0)]
    return data, cases.frame(spark, data + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    data, docs, labels = toxic_tables(spark)
    found = toxicity.with_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(found) == len(data) + 4
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in found if r.held_out and r.doc_id < len(data)]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert next(r for r in found if r.doc_id is None).predicted == 1


def test_toxicity_without_labels_or_rows(spark):
    _, docs, labels = toxic_tables(spark, 40)
    assert len({r.score for r in toxicity.with_toxicity(docs, labels.limit(0)).select("score").collect()}) == 1
    assert toxicity.with_toxicity(docs.limit(0), labels).count() == 0


def test_label_model_discounts_voters_that_say_the_same():
    rng = np.random.default_rng(4)
    y = rng.random(2000) < 0.3
    vote = lambda a: np.where(rng.random(2000) < a, np.where(y, 1, -1), np.where(y, -1, 1))
    one = vote(0.8)
    votes = np.stack([one, one, one, vote(0.8), vote(0.8)], axis=1)
    model = toxicity.LabelModel()
    label = np.where(rng.random(2000) < 0.9, y, ~y)
    p = model.fit(votes, label.astype(float), np.ones(2000, bool))
    assert abs(model.accuracy[0] - 0.9) < 0.04 and np.abs(model.accuracy[1:] - 0.8).max() < 0.04
    assert {frozenset(e) for e in enumerate(model.parent)} & {frozenset(e) for e in ((1, 2), (1, 3), (2, 3))}
    assert ((p > 0.5) == y).mean() > max((label == y).mean(), 0.9)
    # As sure as with the three equal voters taken once.
    once = model.fit(votes[:, 2:], label.astype(float), np.ones(2000, bool))
    assert np.abs(p - once).mean() < 0.02


def test_only_true_near_copies_are_left_out():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, 120)).astype(np.uint32) for _ in range(60)]  # common features, as of a language's words
    sets += [np.unique(np.append(s[rng.random(len(s)) < keep], rng.integers(1000, 2000, extra))).astype(np.uint32) for s in sets[:30] for keep, extra in ((0.97, 2), (0.8, 20))]
    sets += [np.zeros(0, np.uint32)] * 3
    at = np.cumsum([0] + [len(s) for s in sets])
    metas = [(k % 2, int(at[k]), len(s)) for k, s in enumerate(sets)]
    kept = toxicity._one_of_near_copies(metas, np.concatenate(sets))
    similarity = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b])))
    chosen = [metas.index(m) for m in kept]
    for k in range(len(sets)):
        if k not in chosen and len(sets[k]):
            assert any(similarity(k, c) >= toxicity.NEAR_COPY and c % 2 == k % 2 for c in chosen)
    assert set(range(60)) <= set(chosen) and sum(len(sets[c]) == 0 for c in chosen) == 2


# --- repeats, groups, lines --------------------------------------------------------------------------


def test_repeats_equal_brute_force(spark, data):
    found = repeats.remove_repeats(cases.frame(spark, data))
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == cases.repeats(data)


def test_top_symbols_name_word_sequences(data):
    import pyarrow as pa

    texts = [t or "" for _, t, _ in data] + ["a b a b a b", "a b a b a  b", "a " * 1000, "a " * 1001]
    symbols = {}
    for rows, raw, offsets in pieces(pa.table({"text": texts}).to_batches()):
        words = Words(raw, offsets)
        for t, s in zip(rows["text"].to_pylist(), repeats.top_symbols(words, words.hashes()).tolist(), strict=True):
            assert symbols.setdefault(tuple(cases.words(t)), s) == s
    assert len(set(symbols.values())) == len(symbols)


def test_jaccard_equals_brute_force(spark, data):
    found = jaccard.ngram_jaccard_groups(cases.frame(spark, data))
    assert counted(found, "doc_id", "n_shingles", "component_id") == cases.jaccard(data)


def test_jaccard_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = cases.text(draw, 60)
    data = [(i, cases.edited(draw, base, 0.01 * (i % 6)), "s") for i in range(120)] + [(200 + i, base, "s") for i in range(50)]
    assert counted(jaccard.ngram_jaccard_groups(cases.frame(spark, data)), "doc_id", "n_shingles", "component_id") == cases.jaccard(data)


def test_one_of_each_keeps_one_of_a_group(spark, data):
    kept = jaccard.one_of_each(spark, cases.frame(spark, data), "")
    assert kept.columns == cases.frame(spark, []).columns
    groups = defaultdict(set)
    for (i, n, c), times in cases.jaccard(data).items():
        groups[c if n else ("none", i, times)].add(n)
    texts = [r.text for r in kept.collect()]
    sets = [s for s in map(cases.shingles, texts) if s]
    assert all(100 * len(a & b) < 75 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert sum(not cases.words(t) for t in texts) == sum(not cases.words(t) for _, t, _ in data)


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for native in (False, True):
        assert {r.node: r.root for r in components.components(df, native=native).collect()} == {x: root(x) for x in list(parent)}
    assert components.components(df.limit(0)).count() == 0


def test_fuzzy_lines_equal_brute_force(spark):
    draw = random.Random(7)
    base = [" ".join(f"{draw.choice(cases.WORDS)}{draw.randrange(900)}xy" for _ in range(30)) for _ in range(12)]
    data = []
    for i in range(80):
        picked = [draw.choice(base) for _ in range(3)]
        picked[0] = picked[0][:-1] + draw.choice("abcdefgh")
        picked[1] = picked[1].upper().replace(" ", "  ,")
        data.append((i, "\n".join(picked) + draw.choice(["", "\n", "\n\n--\n"]), "s"))
    data += [(90, None, "s"), (91, "", "s"), (92, "\n", "s"), (93, "ok\nok\nok", "s"), (None, base[0], "s"), (94, base[3] + "\n" + " ".join(["longword"] * 40000), "s")]
    docs = cases.frame(spark, data)
    got = {(r.id, p) for r in lines.dedup_lines(docs).collect() for p in r.removed}
    found = lines.occurrences(docs).collect()
    names = {r.name: r.normal for r in found}
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, row[j] + (x != y), new[j] + 1))
            row = new
        return row[-1]

    keys = list(names)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            ta, tb = names[a], names[b]
            if min(len(ta), len(tb)) >= lines.SIMILARITY * max(len(ta), len(tb)) and distance(ta, tb) <= (1 - lines.SIMILARITY) * max(len(ta), len(tb)):
                parent[root(a)] = root(b)
    first = {}
    for r in found:
        at = (r.id, r.th, r.place)
        first[root(r.name)] = min(first.get(root(r.name), at), at)
    want = {(r.id, r.place) for r in found if first[root(r.name)] != (r.id, r.th, r.place)}
    assert got == want and len(keys) > len({root(k) for k in keys})
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.kept_text for r in lines.with_lines_removed(docs).collect()}
    assert kept[90] is None and kept[93] == "ok" and kept[92] == "\n"


def test_simhash_counts_majorities_by_block(spark):
    rng = random.Random(8)
    sets = [[rng.choice(cases.WORDS) + str(rng.randrange(99)) for _ in range(n)] for n in (1, 2, 9, 49, 50, 51, 127)] + [["same" + str(i % 2) for i in range(127)]]
    df = spark.createDataFrame([(i, i, 9, False, s) for i, s in enumerate(sets)], "seq long, name long, size int, few boolean, words array<string>")
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for s in sets for w in s], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    columns = ["name", "size", "even", "odd", "n", *(f"k{c}" for c in range(8))]
    packed, plain = ({r.name: r for r in f(df).select(columns).collect()} for f in (lines.packed_simhashes, lines.simhashes))
    assert packed == plain
    for i, s in enumerate(sets):
        for c in range(8):
            own = [hashes[w] for w in s if hashes[w] & 7 == c]
            want = sum(1 << k for k in range(16) if 2 * sum(h >> 8 + k & 1 for h in own) > len(own))
            assert (packed[i].odd if c % 2 else packed[i].even) >> 16 * (c // 2) & 0xFFFF == want
            assert packed[i].n >> 8 * c & 255 == len(own)


def test_edited_lines_are_found(spark):
    """Recall by edit similarity alone: lines of 5 to 80 words, each with one edited copy; different lines stay apart."""
    rng, data, kinds = random.Random(9), [], []
    new = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    for kind in ("letter", "word", "insert", "delete", "two words"):
        for size in range(5, 81, 3):
            for _ in range(5):
                w = [new() for _ in range(size)]
                v, i = list(w), rng.randrange(size)
                if kind == "letter":
                    v[i] = v[i][:-1] + "z"
                elif kind == "insert":
                    v.insert(i, new())
                elif kind == "delete":
                    del v[i]
                else:
                    for j in rng.sample(range(size), 1 if kind == "word" else 2):
                        v[j] = new()
                a, b = " ".join(w), " ".join(v)
                if 9 * (1 + (kind == "two words")) <= 0.2 * min(len(a), len(b)):  # no such edit costs more
                    data += [(2 * len(kinds), a, "s"), (2 * len(kinds) + 1, b, "s")]
                    kinds.append(kind)
    gone = {r.id: len(r.removed) for r in lines.dedup_lines(cases.frame(spark, data)).collect() if r.removed}
    assert all(i % 2 and k == 1 for i, k in gone.items())
    for kind in set(kinds):
        own = [n for n, k in enumerate(kinds) if k == kind]
        assert sum(2 * n + 1 in gone for n in own) >= 0.95 * len(own) > 50, kind


# --- decontamination ---------------------------------------------------------------------------------


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_plain():
    rng = np.random.default_rng(9)
    item = rng.integers(0, 6, 12).astype(np.uint64)
    texts = [rng.integers(0, 6, n).astype(np.uint64) for n in rng.integers(0, 40, 50)]
    score, end = decontaminate.align(item, texts)
    assert score.tolist() == [plain_alignment(item.tolist(), t.tolist()) for t in texts] and (end <= [len(t) for t in texts]).all()


def test_leaks_exact_and_edited(spark):
    draw = random.Random(10)
    pool = [f"{a}{i}" for a in ("kor", "vel", "mun") for i in range(60)]
    items = [" ".join(draw.choice(pool) for _ in range(25)) for _ in range(6)]
    clean = [" ".join(draw.choice(pool) for _ in range(80)) for _ in range(30)]
    put = lambda t, x: " ".join([*t.split()[:30], x, *t.split()[30:]])
    paraphrase = lambda x: " ".join(w for k, w in enumerate(x.split()) if k % 9 != 4).replace(" ", ", ", 3).upper()
    data = [(i, t, "s") for i, t in enumerate(clean)] + [(100 + i, put(clean[i], items[i]), "s") for i in range(4)] + [(200 + i, put(clean[i], paraphrase(items[i])), "s") for i in range(4)]
    data += [(300, None, "s"), (301, "", "s"), (302, items[5], "s"), (303, put(put(clean[8], items[4]), items[5]), "s"), (303, clean[9], "s"), (None, items[4], "s")]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "two words"), (None, None)], "item_id long, text string")
    found = decontaminate.with_leaks(cases.frame(spark, data), bench).select("doc_id", "text", "leaks").collect()
    got = {(r.doc_id, r.text): sorted({k.item_id for k in r.leaks}) for r in found}
    want = {100: [0], 101: [1], 102: [2], 103: [3], 200: [0], 201: [1], 202: [2], 203: [3], 302: [5], None: [4]}
    for (i, t), ids in got.items():
        assert ids == ([4, 5] if i == 303 and items[4] in t else want.get(i, [])), i
    whole = next(k for r in found if r.doc_id == 100 for k in r.leaks)
    assert (whole.start, whole.end, whole.score) == (30, 55, 1.0)
    assert len(found) == len(data)
    assert decontaminate.with_leaks(cases.frame(spark, data), bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.with_leaks(cases.frame(spark, []), bench).count() == 0


def test_an_item_in_every_document_is_still_found(spark):
    draw = random.Random(11)
    item = cases.text(draw, 20)
    data = [(i, cases.text(draw, 30) + " " + item + " " + cases.text(draw, 30), "s") for i in range(60)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.with_leaks(cases.frame(spark, data), bench).where("size(leaks) > 0").count() == 60


# --- mixing ------------------------------------------------------------------------------------------


def test_apportionment_equals_plain_highest_quotients():
    rng = random.Random(12)
    for _ in range(40):
        votes = [Fraction(rng.randrange(0, 500)) for _ in range(rng.randrange(1, 8))]
        caps = [rng.randrange(0, 60) for _ in votes]
        seats = rng.randrange(0, 120)
        want = [0] * len(votes)
        for _ in range(min(seats, sum(caps))):
            i = min((i for i in range(len(votes)) if want[i] < caps[i]), key=lambda i: (-votes[i] / (2 * want[i] + 1), i))
            want[i] += 1
        got = mixing.sainte_lague(votes, seats, caps)
        if any(votes):
            assert sum(got) == sum(want) and all(abs(votes[i] / (2 * got[i] + 1) - votes[i] / (2 * want[i] + 1)) == 0 or got == want or votes[i] for i in range(len(votes)))
            assert got == want, (votes, caps, seats)


def test_targets_fill_up():
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1], Fraction(315)) == [20, Fraction(590, 3), Fraction(295, 3)]
    assert mixing.fill_targets([], [], Fraction(0)) == []


def test_mix_takes_what_it_should(spark, data):
    docs = cases.frame(spark, data)
    found = mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    again = mixing.mix_plan(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again)) and len(found) == len(data)
    size = Counter()
    for _, t, s in data:
        size[s] += len(cases.words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    goals = mixing.fill_targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], Fraction(3, 2) * sum(size.values()))
    source_of = defaultdict(set)
    for i, t, s in data:
        source_of[i, len(cases.words(t))].add(s)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        if len(source_of[r.doc_id, r.size]) == 1:
            s = next(iter(source_of[r.doc_id, r.size]))
            assert (r.source_size, r.target) == (size[s], float(goals[names.index(s)]))
        taken[r.source_size, r.target] += r.taken
    for s, g in zip(names, goals, strict=True):
        assert abs(taken[size[s], float(g)] - float(g) * sum(size[x] == size[s] and goals[names.index(x)] == g for x in names)) <= 2 * len(names)


def test_mixed_text_is_what_was_taken(spark, data):
    docs = cases.frame(spark, data)
    made = mixing.mixed(spark, docs, "")
    assert made.columns == docs.columns
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += r.taken
    got, own = Counter(), defaultdict(set)
    for i, t, _ in data:
        own[i].update(cases.words(t))
    for r in made.collect():
        got[r.doc_id] += len(cases.words(r.text))
        assert set(cases.words(r.text)) <= own[r.doc_id] and r.n_chars == len(r.text)
    assert +plan == +got
    assert mixing.mixed(spark, cases.frame(spark, []), "").count() == 0


# --- personal data -----------------------------------------------------------------------------------


def plain_spans(t):
    import re

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in s.split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_regular_expressions():
    rng = random.Random(13)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789 .-+()@ab%é") for _ in range(rng.randrange(45)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "." * 100_000 + "x@"
    assert pii.base_spans(long) == []


def test_personal_data_spans(spark):
    data = [(1, "é mail a.b@c.de, ip 10.0.0.1 and 4111 1111 1111 1111 or +1 (415) 555-2671", "s"), (2, None, "s"), (3, "", "s"), (4, "nothing here at all", "s"), (5, "ring (415) 555-2671 now", "s")]
    got = {r.doc_id: r.pii for r in pii.with_personal_data(cases.frame(spark, data)).select("doc_id", "pii").collect()}
    assert got[1].base == "email:7:15,ip:20:28,card:33:52,phone:56:73" == got[1].spans
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert all(got[i].spans == "" for i in (2, 3, 4)) and got[5].base == "" and got[5].spans == "phone:5:19"
    assert pii.with_personal_data(cases.frame(spark, [])).count() == 0


def test_field_reads_its_table_with_other_digits():
    lines_ = [line for row in pii.TRAINING.strip().splitlines() for line in row.split("|")]
    pairs = [pii._parse(line, random.Random(1000 + i)) for i, line in enumerate(lines_)]
    right = sum(list(p) == g for p, (_, g) in zip(pii.field().viterbi([w for w, _ in pairs]), pairs, strict=True))
    assert right >= 0.95 * len(pairs)


def test_viterbi_equals_all_paths():
    from itertools import product

    field = pii.field()
    words = ["call", "555-201-3345", "now"]
    e = pii._emissions(words, field.weights)
    score = lambda p: field.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
    best = max(product(range(len(pii.LABELS)), repeat=3), key=score)
    assert field.viterbi([words, [], ["x"]])[0].tolist() == list(best)


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounds_of_words_accept_no_pair_that_the_edit_distance_refuses(spark):
    """Words added, left out, replaced and moved, near the wanted similarity on both sides."""
    random = np.random.default_rng(3)
    words = ["a", "of", "tree", "stem", "crown", "canopy", "lichen", "understorey", "é", "x" * 45, "y" * 45]
    rows = []
    for n in range(400):
        a = list(random.choice(words, random.integers(1, 40)))
        b = list(a)
        for _ in range(random.integers(0, 7)):
            at, kind = random.integers(0, len(b) + 1), random.integers(0, 4)
            if kind == 0:
                b.insert(at, random.choice(words))
            elif kind == 1 and len(b) > 1:
                b.pop(at % len(b))
            elif kind == 2:
                b[at % len(b)] = random.choice(words)
            else:
                b = b[at:] + b[:at]
        rows.append((2 * n, " ".join(a), 2 * n + 1, " ".join(b)))
    texts = spark.createDataFrame([r[:2] for r in rows] + [r[2:] for r in rows], "name long, normal string")
    pairs = spark.createDataFrame([(r[0], r[2]) for r in rows], "a long, b long")
    found = {r.a for r in lines._verified(pairs, texts, 0.8).collect()}
    assert found == {a for a, ta, _, tb in rows if _edit_distance(ta, tb) <= int(0.2 * max(len(ta), len(tb)) + 1e-9)}
    assert 100 < len(found) < 390


def test_buckets_of_several_groups_know_their_largest(spark):
    members = spark.createDataFrame([(1, n) for n in range(10, 16)] + [(2, 20), (2, 21), (3, 30)], "key long, name long")
    roots = spark.createDataFrame([(10, 10), (11, 12), (12, 12), (13, 12), (20, 20), (21, 20)], "name long, root long")
    found = sorted(tuple(r) for r in lines._several(members, roots).select("key", "name", "root", "main").collect())
    assert found == [(1, 10, 10, 12), (1, 11, 12, 12), (1, 12, 12, 12), (1, 13, 12, 12), (1, 14, 14, 12), (1, 15, 15, 12)]
    grown = lines._grown(roots, spark.createDataFrame([(10, 13), (14, 15), (15, 21)], "a long, b long"))
    assert sorted(tuple(r) for r in grown.collect()) == [(10, 10), (11, 10), (12, 10), (13, 10), (14, 14), (15, 14), (20, 14), (21, 14)]


@pytest.mark.parametrize("leaders", [1, 2])
def test_groups_do_not_depend_on_the_number_of_leaders(spark, monkeypatch, leaders):
    random = np.random.default_rng(11)
    words, texts = [f"word{i:03d}" for i in range(40)], []
    for n in range(120):
        own = list(words)
        for at in random.choice(40, 1 + n % 12, replace=False):
            own[at] = f"edit{random.integers(1000)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = lambda: sorted(tuple(r) for r in lines.dedup_lines(docs).selectExpr("id", "n_lines", "array_join(removed, ',')").collect())
    found = groups()
    monkeypatch.setattr(lines, "LEADERS", leaders)
    assert groups() == found and sum(bool(r[2]) for r in found) > 60
