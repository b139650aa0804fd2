"""The field on labelled spans that its training table doesn't hold, and on very long chains."""

import random
import tracemalloc

import numpy as np

from arborel.llm import pii

# Labelled spans in other sentences, with other names and numbers than the training table's.
HELD_OUT = """
please ring [phone:617-555-0148] before lunch|our office, [phone:(312) 555-0190], is closed|text [phone:303.555.0117] when you land|fax [phone:+1 (212) 555-0163] the form
reach the desk at [phone:+44 161 496 0753] daily|his cell is [phone:408 555 0126] now|try [phone:1-888-555-0142] for billing|the hotline [phone:+49 89 636480] is free
reply to [email:nina at webmail dot com] soon|notes go to [email:omar (at) lab.example.net] only|write [email:zoe[at]mail[dot]org] for a copy|ask [email:li at example dot edu] about it
forward it to [email:tom_r@news.example.org] today|cc [email:press+uk@site.example.com] as well|send [email:ivy at post dot example dot net] the list|mail [email:ed (at) school.edu] first
the router [ip:10.1.2.3] rebooted|block [ip:198.51.100.23] at once|traffic from [ip:192.0.2.44] to [ip:10.20.30.40] rose|ssh into [ip:172.16.9.8] tonight
charge [card:4111 1111 1111 1111] again|the card [card:5500 0000 0000 0004] was lost|visa [card:4012-8888-8888-1881] declined|pay by [card:378282246310005] please
"""
NOTHING = """
chapter 12 begins at page 340|we met 30 people in 2015|the train at 10:45 had 8 cars|it weighs 3.5 kg and costs 20.99|version 2.14.3 fixed 17 bugs|look at the dot on the map
the committee sat at noon and at six|room 2201 seats 45|the 1987 edition has 512 pages|between 100 and 200 birds were seen|his score of 98.6 was best|a ratio of 4:3 or 16:9
"""


def labelled(table: str) -> list[tuple[str, set]]:
    out = []
    for line in [line for row in table.strip().splitlines() for line in row.split("|")]:
        words, labels = pii._parse(line, None)
        spans, at = [], 0
        for w, y in zip(words, labels, strict=True):
            if pii.LABELS[y][0] == "B":
                spans.append([pii.LABELS[y][2:], at, at + len(w.rstrip(","))])
            elif y:
                spans[-1][2] = at + len(w.rstrip(","))
            at += len(w) + 1
        out.append((" ".join(words), {tuple(s) for s in spans}))
    return out


def found(texts: list[str]) -> list[set]:
    return [{(pii.KINDS[k], a, b) for a, k, b in x} for x in pii.added_spans(texts, [[] for _ in texts])]


def test_recall_and_precision_on_held_out_spans():
    """By the field alone, without the patterns: spans that are right to the character."""
    table = labelled(HELD_OUT)
    got = found([t for t, _ in table])
    wanted, right, given = (sum(map(len, x)) for x in ([w for _, w in table], [g & w for g, (_, w) in zip(got, table, strict=True)], got))
    assert right >= 0.8 * wanted and right >= 0.8 * given, (right, wanted, given)
    assert sum(map(len, found([t for t, _ in labelled(NOTHING)]))) <= 1


def test_long_chains_are_decoded_alike_in_pieces(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice(["12", "call", "555-201-3345", "at", "4111", "1111", "x@y.org", "10.0.0.1", "7", "(at)"]) for _ in range(300)]
    field = pii.field()
    whole = field.viterbi([words])[0].tolist()
    for chain in (1, 7, 100, 1000):
        monkeypatch.setattr(pii, "CHAIN", chain)
        assert field.long(lambda i: words[i], len(words)).tolist() == whole
    text = " \n".join(words)
    monkeypatch.setattr(pii, "CHAIN", 4096)
    want = found([text])
    monkeypatch.setattr(pii, "CHAIN", 5)
    assert found([text]) == want


def test_a_text_of_numbers_needs_bounded_memory():
    n = 200_000
    text = "1 22 " * (n // 2)
    pii.field()
    tracemalloc.start()
    pii.added_spans([text], [[]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * n + (20 << 20)


def test_words_equal_regular_expression():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab1 \t\n\x0b\x85é\u2003𝟘") for _ in range(rng.randrange(40)))
        a, b = pii._word_spans(t)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [m.span() for m in pii._WORD.finditer(t)]
    assert [len(x) for x in pii._word_spans("")] == [0, 0]
    assert isinstance(pii._word_spans("x")[0], np.ndarray)


def test_features_follow_the_whole_word():
    assert pii._shape("a" * 100 + "7@b.c") != pii._shape("a" * 100)
