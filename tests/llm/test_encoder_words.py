"""Words of letters a-z and marks after them are encoded by shorter ways, with the ids of the whole text."""

import random

import numpy as np
import public_tokenizers

from arborel.llm import records


def test_words_and_marks_have_the_ids_of_the_whole_text(monkeypatch):
    encoder = records.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.bare
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    draw = random.Random(5)
    stems = ["a", "the", "don", "zebra", "qxzvk", "o" * 300, "naïve", "x1", "É", "<|endoftext|>", "K", "i̇", "ab̸", "we'll", "it's"]
    texts = ["".join(draw.choice(stems) + "".join(draw.choices(marks, k=draw.randrange(5))) + draw.choice([" ", "\n", "", " . "]) for _ in range(60)) for _ in range(300)]
    texts += [s + m + n for s in stems[:5] for m in marks for n in ["", *marks]] + ["", " ", "a" + "̸", "a≠", "abc<|endoftext|>", "abc<| x", "The<", "the|"]
    seen = []
    once = encoder.tokenizer.encode_batch_fast
    for memory in (128 << 20, 0):  # and with a memory that is emptied before every call
        monkeypatch.setattr(records, "KNOWN_BYTES", memory)
        for low in range(0, len(texts), 500):
            part = texts[low : low + 500]
            found = encoder.texts([t.encode() for t in part], b"")
            assert [np.frombuffer(x, encoder.kind).tolist() for x in found] == [e.ids for e in once(part, add_special_tokens=False)]
    # Words of letters, and those with marks whose parts are known, don't go through the whole tokenizer.
    encoder.known.clear()
    monkeypatch.setattr(encoder, "tokenizer", type("Tokenizer", (), {"encode_batch_fast": lambda _, words, **k: seen.extend(words) or once(words, **k)})())
    encoder.texts([b"zebra zebra$$$ plain plain$$$ plain."], b"")
    assert sorted(seen) == ["$$$", "."]
