"""Edited copies of benchmark items, also beside verbatim copies, against full Smith-Waterman."""

import random

from arborel.llm import decontaminate

from . import cases
from .test_text import plain_alignment

WORDS = [f"{a}{i}" for a in ("kor", "vel", "mun") for i in range(60)]


def edits(draw, item):
    new = lambda: f"new{draw.randrange(10**6)}"
    yield list(item)
    for step in (4, 5, 6):
        yield [new() if k % step == step - 1 else w for k, w in enumerate(item)]
        yield [w for k, w in enumerate(item) if k % step != step - 1]
    yield [x for k, w in enumerate(item) for x in ([w, new()] if k % 3 == 2 else [w])]
    yield [w if draw.random() > 0.2 else new() for w in item]
    yield item[: len(item) // 2]
    yield item[: len(item) // 2] + [new() for _ in range(len(item) // 2)] + item[len(item) // 2 :]
    yield [w if k % 2 else new() for k, w in enumerate(item)]


def test_edited_copies_equal_full_alignment(spark):
    draw = random.Random(21)
    items = [[draw.choice(WORDS) for _ in range(draw.choice((12, 25, 40)))] for _ in range(12)]
    data = []
    for item in items:
        for copy in edits(draw, item):
            around = [[draw.choice(WORDS) for _ in range(70)] for _ in range(2)]
            data.append((len(data), " ".join([*around[0], *copy, *around[1]]), "s"))
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, k.item_id, k.score) for r in decontaminate.with_leaks(cases.frame(spark, data), bench).select("doc_id", "leaks").collect() for k in r.leaks}
    scores = {(d, i): plain_alignment(item, t.split()) / len(item) for d, t, _ in data for i, item in enumerate(items)}
    assert got == {(d, i, round(s, 4)) for (d, i), s in scores.items() if s >= 0.5}
