"""Copies of an item that stand close together."""

import random

from arborel.llm import decontaminate

from . import cases
from .test_leaks_edited import WORDS


def test_each_of_several_close_copies_has_its_span(spark):
    draw = random.Random(23)
    items = [" ".join(draw.choice(WORDS) for _ in range(20)) for _ in range(4)]
    gap = lambda n: " ".join(f"new{draw.randrange(10**6)}" for _ in range(n))
    data = [(i, " ".join([gap(5), item, gap(4), item, gap(2), items[0], item, gap(7)]), "s") for i, item in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: sorted((k.item_id, k.start, k.end, k.score) for k in r.leaks) for r in decontaminate.with_leaks(cases.frame(spark, data), bench).collect()}
    own = lambda i: [(i, 5, 25, 1.0), (i, 29, 49, 1.0), (i, 71, 91, 1.0)]
    assert got == {i: sorted([*own(i), (0, 51, 71, 1.0)]) for i in range(4)}
