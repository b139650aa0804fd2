"""Groups whose ids don't tell them apart: each keeps a document."""

import random

from arborel.llm import jaccard

from . import cases


def test_unlinked_texts_under_null_and_repeated_ids_all_stay(spark):
    draw = random.Random(22)
    text = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(40))
    near = lambda t: t + " more"
    null, same, other = [text() for _ in range(6)], [text() for _ in range(5)], text()
    data = [(None, t, "s") for t in null] + [(None, near(null[0]), "s"), (None, null[1], "s")]
    data += [(7, t, "s") for t in same] + [(9, near(same[0]), "s"), (7, near(same[1]), "s"), (None, near(same[2]), "s"), (3, other, "s"), (8, near(other), "s")]
    kept = jaccard.one_of_each(spark, cases.frame(spark, data), "").select("doc_id", "text").collect()
    group = lambda t: t.removesuffix(" more")
    assert sorted(group(r.text) for r in kept) == sorted({group(t) for _, t, _ in data})
    least = {}
    for i, t, _ in data:
        least[group(t)] = min(least.get(group(t), cases.order(None)), cases.order(i))
    assert all(cases.order(r.doc_id) == least[group(r.text)] for r in kept)
