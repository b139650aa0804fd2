"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field labels words (runs without ASCII white space) with O, or B and I of a kind. It looks at *islands*: words with a digit or
an at sign, a few trigger words, and the words near them; elsewhere the label is O. It is trained by gradient ascent of
the likelihood on the small labelled table below, with numbers drawn anew by rule, and decoded by Viterbi over batches of islands.
A span that it adds must be well formed for its kind and must not overlap a pattern's span.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, pieces, prepare, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words around a striking one that belong to its island; buckets of features; rounds of training.
NEAR, BUCKETS, ROUNDS, VARIANTS = 3, 1 << 13, 60, 6

#: Characters of words whose features are remembered; words of a chain that are decoded at once.
REMEMBERED, CHAIN = 64, 4096

# Fixed training table: text with [kind:span]; a digit stands for any digit.
TRAINING = """
call [phone:555-201-3345] after six|ring [phone:(555) 201-3345] or [phone:555.201.3345] today|tel [phone:+44 20 7946 0958] , office
phone: [phone:+1 (415) 555-2671] and fax [phone:+1 (415) 555-2672]|mobile [phone:07700 900123] please|contact [phone:+49 30 901820] in Berlin
my number is [phone:555 201 3345] thanks|whatsapp [phone:+33 6 12 34 56 78] soon|dial [phone:1-800-555-0199] for help|cell [phone:415-555-0132]
write to [email:ann.lee@example.org] now|mail [email:bob_23@mail.example.com] , please|contact [email:sales+eu@shop.example.co.uk] today
reach [email:jo at example dot org] by Friday|send it to [email:max.roe at mail dot example dot com] please|user [email:x9@host.example.net] left
address [email:kim (at) example.org] here|ask [email:pat[at]example[dot]com] first|write [email:lee at site dot net] again
from [ip:10.0.0.12] to [ip:192.168.1.254] port 8080|host [ip:172.16.254.1] is up|ping [ip:8.8.4.4] failed|login from [ip:203.0.113.77] denied
card [card:4111 1111 1111 1111] expires 12/27|paid with [card:5500-0000-0000-0004] yesterday|visa [card:4012888888881881] was used
her line is [phone:206-555-0111], ask for Eve|they moved to [phone:(718) 555-0175] last week|our new number: [phone:512.555.0186] or [phone:512 555 0187]|tell them [phone:+1 650 555 0122] works
from abroad [phone:+39 06 6982 1234], at home [phone:06 6982 1234]|the shop has [phone:+61 2 9374 4000] and [phone:1-877-555-0104]|message [phone:0171 555 0199] after work|[phone:+34 91 123 45 67] is the right one
you find me under [email:sam at host dot com], always|[email:kai (at) dept.example.edu] knows|[email:amy[at]box[dot]net] or [email:joe[at]box[dot]net]|for help [email:info at shop dot example dot com] is best|it went to [email:r.diaz (at) firm.example.com] twice
both [email:eva@home.example] and [email:al.b@work.example.com] bounced|mailto [email:desk at town dot gov], or come at noon|server [ip:10.9.8.7], gateway [ip:10.9.8.1]|deny [ip:203.0.113.5] and [ip:203.0.113.6], please|[ip:192.168.0.30] answers
use [card:4242 4242 4242 4242] or [card:5105-1051-0510-5100] to test|it charged [card:6011111111111117], twice|old card [card:3714 496353 98431] is void|[card:5555 5555 5555 4444] was refused
number [card:378282246310005] is stored|pan [card:6011 0009 9013 9424] on file
in 1999 there were 1200 people at the market|version 1.2.3 of the tool at 10:30|it cost 1,299.00 euros in 2024|see pages 12-15 and 20
the score was 3-2 at half time|room 101 is at the end of floor 3|born on 12.05.1987 in Rome|call me at noon or at 5 pm
id 550e8400 and key a9f3c2d1e0b4 are old|section 4.2.1 at page 77|order 100200300 of 3 items|at 9 we met at the dot of the line
on 2023-11-05 at 14:22:07 it began|password=f3a9c0d1e2 was reset|token "9f8e7d6c5b4a39281706" expired|price 49.99 and 5 % off
about 7000 of 12000 at most|ISBN 978-3-16-148410-0 is a book|zip 94103 and 10115|the year 2001 at the site was 50 km away
"""
_TRIGGERS = {"at", "dot", "(at)", "[at]", "tel", "phone", "phone:", "call", "mobile", "card", "ip", "email", "mail"}

_DIGITS_DOTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS_GAPS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What makes a text worth a look and a word striking: a digit, an at sign, the word at or dot, or either in brackets, also inside a word.
_STRIKING = re.compile(r"[0-9@]+|(?<![^\x20\x09-\x0D])(?:at|dot)(?![^\x20\x09-\x0D])|[(\[](?:at|dot)[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns' matches, leftmost and non-overlapping for each kind, sorted. Linear in the text."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, 0, m.end()))
                done = m.end()
            else:
                done = at + 1
            at = text.find("@", done)
    for m in _DIGITS_DOTS.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            if all(map(_byte, own)):
                out.append((start, 1, start + size))
            start += size + 1
    for m in _DIGITS_GAPS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -------------------------------------------------------------------------------------


def _shape_of(word: str) -> tuple[str, ...]:
    """Features of a word by its shape: letters as a or A, digits as 9, runs shortened; a trigger word is itself."""
    low = word.lower()
    full = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", word))
    short = re.sub(r"(.)\1{3,}", r"\1\1\1+", full)
    digits = sum(c == "9" for c in full)
    return (
        "s" + re.sub(r"(.)\1+", r"\1", full), "l" + short, f"d{min(digits, 20)}", "p" + full[:2], "e" + full[-2:],
        "t" + (low.strip(".,;:") if low.strip(".,;:") in _TRIGGERS or low in _TRIGGERS else ""), f"n{min(len(full), 12) if digits else 0}",
        "@" + str(full.count("@")), "." + str(min(full.count("."), 4)),
    )


def _columns_of(before: str, word: str, after: str) -> np.ndarray:
    shape, left, right = _shape(word), _shape(before), _shape(after)
    names = [*shape, *("<" + f for f in left), *(">" + f for f in right), "both" + left[0] + "|" + shape[0] + "|" + right[0]]
    return np.array([zlib.crc32(n.encode()) % BUCKETS for n in names])


_cached_shape, _cached_columns = lru_cache(1 << 16)(_shape_of), lru_cache(1 << 16)(_columns_of)


def _shape(word: str) -> tuple[str, ...]:
    return (_cached_shape if len(word) <= REMEMBERED else _shape_of)(word)


def _columns(before: str, word: str, after: str) -> np.ndarray:
    return (_cached_columns if max(len(before), len(word), len(after)) <= REMEMBERED else _columns_of)(before, word, after)


def _emissions(words: list[str], weights: np.ndarray, before: str = "", after: str = "") -> np.ndarray:
    padded = [before, *words, after]
    return np.stack([weights[_columns(*padded[i : i + 3])].sum(axis=0) for i in range(len(words))])


def _parse(line: str, draw: random.Random) -> tuple[list[str], list[int]]:
    text, spans = "", []
    for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[(?:at|dot)\])+\])", line):
        m = re.fullmatch(r"\[(\w+):(.+)\]", part)
        if m:
            spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2] if m else part
    if draw:
        text = re.sub(r"[0-9]", lambda m: str(draw.randrange(10)), text)
    words, labels = [], []
    for m in _WORD.finditer(text):
        words.append(m.group())
        own = [(a, k) for a, b, k in spans if a <= m.start() < b]
        labels.append(LABELS.index(("B-" if own[0][0] == m.start() else "I-") + own[0][1]) if own else 0)
    return words, labels


def _allowed() -> np.ndarray:
    """0 where label j may follow label i, else a large negative number: I follows B or I of its kind only."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[1:] != b[1:]:
                    out[i, j] = -1e4
    return out


class Field:
    """Weights of a linear-chain conditional random field, trained on TRAINING."""

    def __init__(self):
        draw, rows = random.Random(5), []
        lines = [line for row in TRAINING.strip().splitlines() for line in row.split("|")]
        for v in range(VARIANTS):
            rows += [_parse(line, draw if v else None) for line in lines]
        n, size = len(LABELS), np.array([len(w) for w, _ in rows])
        self.weights, self.moves = np.zeros((BUCKETS, n)), np.zeros((n, n))
        self.start = np.array([-1e4 if label[0] == "I" else 0.0 for label in LABELS])
        hard, live = _allowed(), np.arange(size.max())[None, :] < size[:, None]
        columns = np.concatenate([np.stack([_columns(*["", *w, ""][i : i + 3]) for i in range(len(w))]) for w, _ in rows])
        gold = np.zeros(live.shape, int)
        gold[live] = np.concatenate([g for _, g in rows])
        marked = np.zeros((*live.shape, n))
        marked[live, gold[live]] = 1
        pairs = live[:, 1:]
        moved = np.zeros((n, n))
        np.add.at(moved, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        order = np.argsort(columns, axis=None, kind="stable")
        known, first = np.unique(columns.reshape(-1)[order], return_index=True)
        word = order // columns.shape[1]
        g2w, g2m = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        for _ in range(ROUNDS):
            e = np.zeros((*live.shape, n))
            e[live] = self.weights[columns].sum(axis=1)
            node, pair = self._marginals(e, self.moves + hard, live)
            gw, gm = -0.02 * self.weights, -0.02 * self.moves
            gw[known] += np.add.reduceat((marked - node)[live][word], first)
            gm += moved - pair
            g2w += gw * gw
            g2m += gm * gm
            self.weights += 0.5 * gw / np.sqrt(g2w)
            self.moves += 0.5 * gm / np.sqrt(g2m)
        self.moves += hard

    def _marginals(self, e: np.ndarray, moves: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chains (rows of e, as far as live): each word's probabilities of labels, and the expected number of each move."""
        log_sum = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + self.start
        for t in range(1, e.shape[1]):
            ahead[:, t] = np.where(live[:, t, None], e[:, t] + log_sum(ahead[:, t - 1, :, None] + moves, 1), ahead[:, t - 1])
        for t in range(e.shape[1] - 2, -1, -1):
            back[:, t] = np.where(live[:, t + 1, None], log_sum(moves + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(ahead[:, -1], 1)[:, None]
        pair = np.zeros_like(moves)
        for t in range(e.shape[1] - 1):
            own = np.exp(ahead[:, t, :, None] + moves + (e[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, :, None])
            pair += own[live[:, t + 1]].sum(axis=0)
        return np.exp(ahead + back - total[:, :, None]) * live[:, :, None], pair

    def viterbi(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each chain of words; chains of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        for low in range(0, len(order), 256):
            own = order[low : low + 256]
            size = np.array([len(chains[i]) for i in own])
            e = np.zeros((len(own), int(size.max(initial=0)), len(LABELS)))
            for r, i in enumerate(own):
                if chains[i]:
                    e[r, : size[r]] = _emissions(chains[i], self.weights)
            score, back = e[:, 0] + self.start, []
            for t in range(1, e.shape[1]):
                step = score[:, :, None] + self.moves
                from_ = step.argmax(axis=1)
                new = np.take_along_axis(step, from_[:, None, :], 1)[:, 0] + e[:, t]
                live = (t < size)[:, None]
                score = np.where(live, new, score)
                back.append(np.where(live, from_, np.arange(len(LABELS))))
            label = score.argmax(axis=1)
            path = [label]
            for from_ in reversed(back):
                label = from_[np.arange(len(own)), label]
                path.append(label)
            path = np.stack(path[::-1], axis=1)
            for r, i in enumerate(own):
                out[i] = path[r, : size[r]]
        return out


    def long(self, word: Callable[[int], str], n: int) -> np.ndarray:
        """The best labels of one chain of n words, word(i) being the i-th: what viterbi() gives, CHAIN words at a time with carried scores; one byte is held for each word and label."""
        back, score = np.zeros((n, len(LABELS)), np.int8), self.start.copy()
        everyone = np.arange(len(LABELS))
        for low in range(0, n, CHAIN):
            high = min(n, low + CHAIN)
            e = _emissions([word(i) for i in range(low, high)], self.weights, word(low - 1) if low else "", word(high) if high < n else "")
            for t in range(low, high):
                if t:
                    step = score[:, None] + self.moves
                    back[t] = step.argmax(axis=0)
                    score = step[back[t], everyone]
                score = score + e[t - low]
        out = np.zeros(n, np.int8)
        if n:
            out[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


@lru_cache(1)
def field() -> Field:
    return Field()


def _word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words, PIECE characters at a time."""
    starts, ends, before = [], [], True
    for low in range(0, len(text), PIECE):
        code = np.frombuffer(text[low : low + PIECE].encode("utf-32-le"), np.uint32)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        edge = space != np.append(before, space[:-1])
        starts.append((low + np.flatnonzero(edge & ~space)).astype(np.int32))
        ends.append((low + np.flatnonzero(edge & space)).astype(np.int32))
        before = bool(space[-1])
    if not before:
        ends.append(np.array([len(text)], np.int32))
    none = [np.zeros(0, np.int32)]
    return np.concatenate(starts or none), np.concatenate(ends or none)


def islands(text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Starts and ends of a text's words, and the words (first, last and one) of each island."""
    starts, ends = _word_spans(text)
    near = np.zeros(len(starts) + 1, np.int32)
    found = (m.start() for m in _STRIKING.finditer(text))
    while len(at := np.fromiter(islice(found, PIECE), np.int32)):
        striking = np.unique(np.searchsorted(starts, at, "right") - 1)
        np.add.at(near, np.maximum(0, striking - NEAR), 1)
        np.add.at(near, np.minimum(len(starts), striking + NEAR + 1), -1)
    inside = np.concatenate([[False], np.cumsum(near[:-1], dtype=np.int32) > 0, [False]])
    return starts, ends, list(zip(np.flatnonzero(inside[1:] & ~inside[:-1]).tolist(), np.flatnonzero(inside[:-1] & ~inside[1:]).tolist(), strict=True))


def _well_formed(kind: int, span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", span) and re.search(r"\.|\bdot\b", span))
    if kind == 1:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(map(_byte, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", span)


def _spans_of(path: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Kind, first word and last word and one of each labelled span."""
    marked, t = np.flatnonzero(path), 0
    while t < len(marked):
        first = int(marked[t])
        kind, end = (int(path[first]) - 1) // 2, first + 1
        while end < len(path) and path[end] == 2 * kind + 2:
            end += 1
        t += end - first
        yield kind, first, end


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text that are well formed and apart from the base spans."""
    chains, owner, decoded = [], [], []
    for i, text in enumerate(texts):
        starts, ends, found = islands(text)
        for low, high in found:
            if high - low > CHAIN:
                own = starts[low:high], ends[low:high]
                decoded.append((i, *own, field().long(lambda k, own=own, text=text: text[own[0][k] : own[1][k]], high - low)))
            else:
                chains.append((starts[low:high], ends[low:high]))
                owner.append(i)
    labels = field().viterbi([[texts[o][a:b] for a, b in zip(*c, strict=True)] for c, o in zip(chains, owner, strict=True)])
    decoded += [(o, *c, path) for o, c, path in zip(owner, chains, labels, strict=True)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for o, starts, ends, path in decoded:
        first = sorted(base[o])
        begin = [s for s, _, _ in first]
        furthest = np.maximum.accumulate([e for _, _, e in first]) if first else np.zeros(0, int)
        for kind, low, high in _spans_of(path):
            a, b = int(starts[low]), int(ends[high - 1])
            while a < b and texts[o][a] in "\"'<,;:":
                a += 1
            while b > a and texts[o][b - 1] in "\"'>.,;:!?":
                b -= 1
            before = bisect_left(begin, b)  # base spans that begin before this one ends
            if (not before or furthest[before - 1] <= a) and _well_formed(kind, texts[o][a:b]):
                out[o].append((a, kind, b))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base: string, spans: string>"


def _find(column: pa.Array) -> pa.Array:
    out = []
    for rows, _, _ in pieces([pa.RecordBatch.from_arrays([column], names=["text"])]):
        some = [i for i, t in enumerate(rows["text"].to_pylist()) if t and _STRIKING.search(t)]
        texts = [rows["text"][i].as_py() for i in some]
        base = [base_spans(t) for t in texts]
        both = dict(zip(some, zip(base, added_spans(texts, base), strict=True), strict=True))
        for i in range(rows.num_rows):
            found, more = both.get(i, ([], []))
            counts = [sum(k == j for _, k, _ in found) for j in range(4)]
            out.append((*counts, _digest(found), _digest(sorted(found + more))))
    fields = ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=fields)


def with_personal_data(docs: DataFrame, name: str = "pii") -> DataFrame:
    """docs (with a column text) and a new struct column of that name: n_email, n_ip, n_card, n_phone (of the patterns' spans), base and
    spans (kind:start:end by start, then kind, joined by commas; of the patterns, and with those that the field adds).

    Places are code points, the end exclusive. A null text counts as empty and has none. Repeated rows are each judged by themselves.
    All columns of docs stay; one that has the new column's name is replaced. Memory grows with a text's bytes, some 20 a word, whatever it holds.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(_find, _OUT).asNondeterministic()(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the patterns' counts, base_sha256 of their spans, and all spans."""
    found = with_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2("pii.base", 256).alias("base_sha256"), "pii.spans")
