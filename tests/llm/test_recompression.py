"""Recompression and word names: words that sums of powers would confuse, long passages, windows that symbols settle."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arborel.llm import jaccard, repeats
from arborel.llm.common import Words, hash_spans, pieces

from . import cases


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def twins(n: int) -> tuple[str, str]:
    """Two words of n letters that every sum of byte values by powers modulo 2**64 gives one hash, if n is 1,024 or more (Thue-Morse words)."""
    swap, a = str.maketrans("ab", "ba"), "a"
    while len(a) < n:
        a += a.translate(swap)
    return a, a.translate(swap)


@pytest.mark.parametrize("n", [512, 1024, 2048, 65536])
def test_twin_words_stay_apart(spark, n):
    a, b = twins(n)
    draw = random.Random(n)
    shared = cases.text(draw, 12)
    data = [(1, a, "s"), (2, b, "s"), (3, f"{shared} {a}", "s"), (4, f"{shared} {b}", "s"), (5, f"x {shared} {b} y", "s")]
    docs = cases.frame(spark, data)
    assert counted(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == cases.repeats(data)
    assert counted(jaccard.ngram_jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == cases.jaccard(data)


def test_span_hashes_depend_on_bytes_and_seed_alone():
    draw = random.Random(1)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 40))) for _ in range(3000)} | {"\0", "\0\0", "\0" * 8, "\0" * 9, "\0" * 16}
    names = {}
    for left in ("", "zz", "longer text before "):
        for w in words:
            raw = np.frombuffer((left + w + "!").encode(), np.uint8)
            name = hash_spans(raw, np.array([len(left)]), np.array([len(left) + len(w)]))[0]
            assert names.setdefault(w, name) == name
    assert len(set(names.values())) == len(words)
    raw = np.frombuffer(b"word", np.uint8)
    assert hash_spans(raw, np.array([0]), np.array([4]), 1) != hash_spans(raw, np.array([0]), np.array([4]))


def test_symbols_of_a_passage_are_equal_inside_any_text():
    draw = random.Random(2)
    passage = cases.text(draw, 400)
    seen = []
    for i in range(6):
        texts = [f"{cases.text(draw, 30 + i)} {passage} {cases.text(draw, 50)}"]
        for _, raw, offsets in pieces(pa.table({"text": texts}).to_batches()):
            words = Words(raw, offsets)
            names, _, start, size = repeats.symbols(words, [words.hashes(), words.hashes(seed=1)], 26)
            inside = (start >= 30 + i + 15) & (start + size <= 30 + i + 385)
            seen.append(set(zip(names[0][inside].tolist(), names[1][inside].tolist(), (start[inside] - i).tolist(), size[inside].tolist(), strict=True)))
    common = set.intersection(*seen)
    assert common and max(n for *_, n in common) >= 52
    assert sum(len(s - common) for s in seen) <= 0.5 * sum(map(len, seen))


def passages(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    long = [cases.text(draw, n) for n in (30, 55, 120, 700)]
    out = []
    for i in range(40):
        parts = [cases.text(draw, draw.randrange(1, 40))]
        for p in draw.sample(long, draw.randrange(0, 3)):
            w = p.split(" ")
            a = draw.randrange(0, 9) if draw.random() < 0.5 else 0
            parts += [" ".join(w[a : len(w) - draw.randrange(0, 9)]), cases.text(draw, draw.randrange(0, 20))]
        if draw.random() < 0.2:
            parts.append("same " * draw.randrange(10, 200))
        out.append((draw.choice([i, i // 2, None]), " ".join(parts), "s"))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_long_passages_and_runs_equal_brute_force(spark, seed):
    data = passages(seed)
    found = repeats.remove_repeats(cases.frame(spark, data))
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == cases.repeats(data)


def test_long_symbols_settle_most_windows(spark):
    """Of a passage of 700 words only the windows at its ends are named one by one."""
    draw = random.Random(4)
    passage = cases.text(draw, 700)
    docs = pa.table({"key": pa.array([1, 2], pa.int64()), "id": pa.array([1, 2], pa.int64()), "text": [f"{cases.text(draw, 20)} {passage}", f"{cases.text(draw, 25)} {passage}"]})
    (rows, raw, offsets) = next(pieces(docs.to_batches()))
    words = Words(raw, offsets)
    names, doc, start, size = repeats.symbols(words, [words.hashes(), words.hashes(seed=1)], 26)
    named = np.empty(len(doc), repeats._SPAN)
    for column, values in repeats._named(rows, words, doc, names, start, size).items():
        named[column] = values
    _, known = repeats._settle_spans(named)
    own = known["range"][known["key"] == 2].tobytes()
    inside = repeats._depth(words, [None, own], 12)[words.bound[1] :] > 0
    assert inside.sum() >= 0.6 * 700
