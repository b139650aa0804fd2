"""The field sees every text and word that could begin a span, whatever else the text holds."""

from arborel.llm import pii

from . import cases


def test_each_positive_training_line_alone(spark):
    lines = [line for row in pii.TRAINING.strip().splitlines() for line in row.split("|")]
    data, want = [], {}
    for i, line in enumerate(lines):
        words, labels = pii._parse(line, None)
        if any(labels):
            data.append((i, " ".join(words), "s"))
            at, spans = 0, []
            for w, y in zip(words, labels, strict=True):
                if pii.LABELS[y][0] == "B":
                    spans.append([pii.LABELS[y][2:], at, at + len(w.rstrip(","))])
                elif y:
                    spans[-1][2] = at + len(w.rstrip(","))
                at += len(w) + 1
            want[i] = {(k, a, b) for k, a, b in spans}
    rows = pii.with_personal_data(cases.frame(spark, data)).select("doc_id", "pii").collect()
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.pii.spans.split(",") if s)} for r in rows}
    emails = {i for i, spans in want.items() if any(k == "email" for k, _, _ in spans)}
    assert len(emails) >= 9 and {i: got[i] for i in emails} == {i: want[i] for i in emails}
    assert {i for i in want if not got[i]} == set()


def test_gate_ignores_unrelated_content_and_the_kind_of_white_space(spark):
    texts = ["write lee at site dot net again", "write lee at site dot\nnet again", "write lee\tat\tsite\tdot\tnet again", "ask pat[at]example[dot]com first", "address kim (at) example.org here"]
    far = " and so on for many more plain words until "
    data = [(2 * i + j, t + far + more, "s") for i, t in enumerate(texts) for j, more in enumerate(("none", "12 items"))]
    got = {r.doc_id: r.pii.spans for r in pii.with_personal_data(cases.frame(spark, data)).select("doc_id", "pii").collect()}
    assert all(got[2 * i] == got[2 * i + 1] != "" for i in range(len(texts)))
