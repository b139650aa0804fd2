"""Answers derived from those of similar sets, and lists with several groups."""

import random
from collections import Counter

from arborel.llm import jaccard

from . import cases


def test_derived_answers_are_right(spark):
    draw = random.Random(1)
    base = [set(range(100 * i, 100 * i + 60)) for i in range(3)]
    sets = {i: (base[i % 3] | set(draw.sample(range(400), draw.randrange(12)))) - set(draw.sample(range(400), draw.randrange(60))) for i in range(40)}
    sets |= {40 + i: sets[0] | set(range(500, 500 + i)) for i in range(0, 40, 3)}
    both = lambda a, b: len(sets[a] & sets[b])
    keys = sorted(sets)
    every = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :]]
    met = [(a, b, len(sets[a]), len(sets[b]), both(a, b)) for a, b in every if draw.random() < 0.4]
    pairs = [p for p in every if p not in {m[:2] for m in met}]
    found = jaccard.derived(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(met, "a long, b long, na long, nb long, both long"), 75).collect()
    assert sorted((r.a, r.b) for r in found) == pairs
    decided = [r for r in found if r.link is not None]
    assert all(r.link == (100 * both(r.a, r.b) >= 75 * len(sets[r.a] | sets[r.b])) for r in decided)
    assert {r.link for r in decided} == {True, False}


def test_common_list_with_several_groups(spark, monkeypatch):
    """Many sets that share rare shingles but fall in several groups, in blocks of a few rows."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    draw = random.Random(2)
    start = cases.text(draw, 30)
    data = []
    for g in range(4):
        own = cases.text(draw, 25 + g)
        data += [(100 * g + i, f"{start} {cases.edited(draw, own, 0.04 * (i % 4))}", "s") for i in range(22)]
    found = jaccard.ngram_jaccard_groups(cases.frame(spark, data))
    assert Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == cases.jaccard(data)


def test_counts_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    data = cases.rows(3)
    found = jaccard.ngram_jaccard_groups(cases.frame(spark, data).repartition(7))
    assert Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == cases.jaccard(data)


def test_common_lists_are_dealt_out(spark, monkeypatch):
    """Lists of a large group of near copies, in parts of a few rows each."""
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    monkeypatch.setattr(jaccard, "HOT", 0)
    draw = random.Random(6)
    base = cases.text(draw, 50)
    data = [(i, cases.edited(draw, base, 0.01 * (i % 7)), "s") for i in range(90)] + cases.rows(1)
    assert jaccard._parts(10_000).max() > 1
    found = jaccard.ngram_jaccard_groups(cases.frame(spark, data))
    assert Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == cases.jaccard(data)
