"""Toxicity by weak supervision.

A bounded sample of labelled rows is cut in two. One half proposes lexicons (whole words) and patterns (word starts) by their
log odds; with a few fixed lists and typographic patterns these are *voters*, which say toxic, clean or nothing. On the
other half a generative model of the votes is fitted by EM: each voter's accuracy given the unknown true class, and correlations, as
pairwise factors of a tree over the voters. The given label is a voter like the others, whose accuracy is estimated too; EM
begins with it, which ties the model's classes to the wanted ones. The model's posterior classes then train a linear classifier over words and word
starts, which alone scores all texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, absent, mix, pieces, prepare, saved, table

#: Labelled rows of each class that are learned from, at most; chosen by a hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
#: Weights of the classifier, at most.
FEATURES = 1500
#: Log odds that a feature needs; weaker ones add up to a text's length or topic.
LEAST_LOG_ODDS = 2.5
#: Bytes of a word's start that are patterns.
STARTS = (4, 5, 6)
#: How often a given label is right, as EM assumes in its first round only.
LABEL_ACCURACY = 0.98
#: Labelled rows whose features have this Jaccard similarity count as copies, of which one is learned from; features by which they are found.
NEAR_COPY, SKETCH, LEAST_SHARED = 0.75, 8, 3
#: What is added to the counts of a vote, and to those of a vote by its parent's vote.
PRIOR, PARENT_PRIOR = 1.0, 10.0
#: Terms that each half-lexicon takes, and lists that they are dealt to.
TERMS, LISTS = 240, 6
_MAP_BITS = 22

# Fixed word lists: common insults.
SEED_LISTS = {
    "en": "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool jerk bastard",
    "fr": "idiot imbécile crétin débile abruti connard salaud ordure minable stupide",
    "de": "idiot trottel dumm blöd arschloch mistkerl abschaum versager widerlich schwachkopf",
    "es": "idiota imbécil estúpido tonto basura escoria inútil asqueroso payaso patético",
}


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's name and its starts' names, and the text of each: 32-bit hashes, whose last two bits tell the kind (0: word, else a place in STARTS, from 1)."""
    doc, size = words.doc(), words.end - words.start
    names, docs = [words.hashes(lower=True)], [doc]
    for n in STARTS:
        names.append(words.hashes(lower=True, ends=np.minimum(words.end, words.start + n))[size > n])
        docs.append(doc[size > n])
    tagged = [((mix(x ^ np.uint64(k)) >> np.uint64(32)) & np.uint64(0xFFFFFFFC)).astype(np.uint32) | np.uint32(k) for k, x in enumerate(names)]
    return np.concatenate(tagged), np.concatenate(docs)


def _word_names(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    names, _ = features(Words(data, np.array([0, len(data)]), NOT_ALNUM))
    return np.unique(names[names & 3 == 0])


def _extract(batches):
    """Distinct features of each text, and whether it shouts."""
    for rows, data, offsets in pieces(batches):
        words = Words(data, offsets, NOT_ALNUM)
        names, doc = features(words)
        order = np.lexsort((names, doc))
        names, doc = names[order], doc[order]
        new = np.append(True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])) if len(names) else np.zeros(0, bool)
        names, doc = names[new], doc[new]
        edge = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
        marks = np.append(0, np.cumsum(data == 33))
        size = np.maximum(np.diff(offsets), 1)
        shout = np.diff(upper[offsets]) / size > 0.3
        exclaim = np.diff(marks[offsets]) / size > 0.01
        blobs = [names[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"].cast(pa.string()), rows["toxic"], pa.array(blobs, pa.binary()), pa.array(shout), pa.array(exclaim)], names=["doc_id", "toxic", "features", "shout", "exclaim"])


def _odds(names: np.ndarray, docs: np.ndarray, p: np.ndarray, smooth: float = 0.5):
    """Of the features that speak for class 1 (log odds over 1): name, log odds, the signed root of their deviance, and in how much of class 1 they stand;
    and the number of all features. By slices of names, so that memory doesn't grow with their number."""
    n1, n0, out, total = p.sum() + 1, (1 - p).sum() + 1, [], 0
    share, slice_ = n1 / (n1 + n0), (names >> np.uint32(28)).astype(np.int8)
    for s in range(16):
        own = np.flatnonzero(slice_ == s)
        known, inverse = np.unique(names[own], return_inverse=True)
        yes = np.bincount(inverse, p[docs[own]], len(known))
        no = np.bincount(inverse, 1 - p[docs[own]], len(known))
        log = np.log((yes + smooth) / (n1 - yes + smooth)) - np.log((no + smooth) / (n0 - no + smooth))
        both = yes + no
        deviance = 2 * (yes * np.log(np.maximum(yes, 1e-9) / (both * share)) + no * np.log(np.maximum(no, 1e-9) / (both * (1 - share))))
        keep = log > 1
        out.append([x[keep] for x in (known, log, np.sqrt(np.maximum(deviance, 0)), yes)])
        total += len(known)
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), total)


def _hits(names: np.ndarray, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in terms) of each occurrence of one of the sorted terms."""
    found, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(names) if len(terms) else 0, 1 << 20):
        own = names[low : low + (1 << 20)]
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        same = terms[at] == own
        found.append(docs[low : low + (1 << 20)][same].astype(np.int64))
        place.append(at[same])
    return np.concatenate(found), np.concatenate(place)


class LabelModel:
    """A generative model of votes -1, 0, 1 given the unknown class, with pairwise factors, fitted by EM.

    Each voter's vote depends on the class and on the vote of one other voter, its parent in a tree: p(votes | class) is the product of p(vote | class, parent's
    vote). The tree is the one with the highest total mutual information of its pairs given the class (so votes that say the same thing twice count once), and is
    learned anew in each round. The given label is one of the voters; all accuracies are estimated, the label's too.
    """

    def fit(self, votes: np.ndarray, labels: np.ndarray, fit_on: np.ndarray, rounds: int = 20) -> np.ndarray:
        """The posterior of class 1 for each row; the model comes from the rows fit_on. Without evidence a label is right with LABEL_ACCURACY, where EM begins."""
        votes = np.column_stack([np.where(labels > 0, 1, -1), votes])
        n, m = votes.shape
        hot = np.zeros((n, 3 * m), np.float32)
        hot[np.arange(n)[:, None], 3 * np.arange(m) + votes + 1] = 1
        own = hot[fit_on]
        p = np.where(labels > 0, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
        for _ in range(rounds):
            q = p[fit_on].astype(np.float32)
            # Counts of each pair of votes (voter, vote, voter, vote) by class.
            pairs = np.stack([(own.T @ (own * r[:, None])).reshape(m, 3, m, 3) for r in (1 - q, q)]).astype(float)
            totals = np.array([(1 - q).sum(), q.sum()], float) + 1e-9
            single = np.einsum("cjvjv->cjv", pairs)
            self.parent = self._tree(pairs, single, totals)
            self.table = (single + PRIOR) / (totals[:, None, None] + 3 * PRIOR)  # p(vote | class)
            self.accuracy = np.sum(totals * self.table[[0, 1], :, [0, 2]].T, axis=1) / np.maximum((totals[:, None] * (self.table[:, :, 0] + self.table[:, :, 2])).sum(axis=0), 1e-9)
            prior = np.clip(totals[1] / totals.sum(), 0.01, 0.99)
            logit = np.full(n, np.log(prior / (1 - prior)))
            for j, k in enumerate(self.parent):
                if k < 0:
                    ratio = np.log(self.table[1, j] / self.table[0, j])[None, :].repeat(3, axis=0)
                    k = j
                else:  # shrunk to the vote's own table where a parent's vote is rare
                    both = pairs[:, k, :, j, :]
                    given = (both + PARENT_PRIOR * self.table[:, j][:, None, :]) / (both.sum(axis=2, keepdims=True) + PARENT_PRIOR)
                    ratio = np.log(given[1] / given[0])
                logit += ratio[votes[:, k] + 1, votes[:, j] + 1]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return p

    @staticmethod
    def _tree(pairs: np.ndarray, single: np.ndarray, totals: np.ndarray) -> list[int]:
        """Each voter's parent (-1: none) in the maximum spanning tree of mutual information given the class, with voter 0 as its root."""
        joint = pairs / totals[:, None, None, None, None]
        alone = single / totals[:, None, None]
        expected = alone[:, :, :, None, None] * alone[:, None, None, :, :]
        info = (totals[:, None, None] / totals.sum() * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(axis=(2, 4))).sum(axis=0)
        m = len(info)
        parent, best, open_ = [-1] * m, info[0].copy(), set(range(1, m))
        from_ = np.zeros(m, int)
        while open_:
            j = max(open_, key=lambda i: (best[i], -i))
            open_.remove(j)
            parent[j] = int(from_[j])
            closer = info[j] > best
            best, from_ = np.where(closer, info[j], best), np.where(closer, j, from_)
        return parent


class Classifier:
    """Weights by feature, sorted by name, and a bias."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(names)
        self.names, self.weights, self.bias = names[order], weights[order], bias
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[names >> np.uint32(32 - _MAP_BITS)] = True

    def scores(self, words: Words) -> np.ndarray:
        names, doc = features(words)
        at = np.flatnonzero(self.map[names >> np.uint32(32 - _MAP_BITS)])
        total = np.full(len(words.count), self.bias)
        if len(self.names) and len(at):
            found = np.minimum(np.searchsorted(self.names, names[at]), len(self.names) - 1)
            same = self.names[found] == names[at]
            both = np.unique(doc[at][same].astype(np.int64) * len(self.names) + found[same])
            np.add.at(total, both // len(self.names), self.weights[both % len(self.names)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _logistic(x: np.ndarray, p: np.ndarray, rounds: int = 150, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the cross-entropy with soft classes p."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    step = 4 / (np.linalg.norm(x, axis=1).max() ** 2 + 1)
    v, c, p = w.copy(), b, p.astype(np.float32)
    for i in range(rounds):
        error = (1 / (1 + np.exp(-(x @ v + c))) - p).astype(np.float32)
        new = v - step * ((error @ x) / len(p) * 8 + l2 / len(p) * v)
        nb = c - step * float(error.mean()) * 8
        m = i / (i + 3)
        v, c = new + m * (new - w), nb + m * (nb - b)
        w, b = new, nb
    return w, b


def _calibrate(logit: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits that fit p best, by Newton's method; both classes count alike."""
    weight = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    x, theta = np.stack([logit, np.ones(len(logit))], axis=1).astype(float), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (q - p)) + np.array([1e-3 * theta[0], 0])
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        theta = theta - np.clip(np.linalg.solve(curve, slope), -5, 5)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def _one_of_near_copies(metas: list[tuple], names: np.ndarray) -> list[tuple]:
    """Of (label, first name, number of names, ...) those that aren't near copies of an earlier one with the same label: whose names have a Jaccard similarity
    under NEAR_COPY with those of each row kept that shares enough of their SKETCH smallest names (in another order of hashes)."""
    kept, known = [], {}
    for m in metas:
        own = names[m[1] : m[1] + m[2]]
        order = mix(own.astype(np.uint64))
        sketch = np.sort(np.partition(order, min(SKETCH, len(own)) - 1)[:SKETCH] if len(own) else order).tolist()
        near = Counter(k for x in sketch for k in known.get((x, m[0]), ()))
        for k, shared in near.items():
            if shared < min(LEAST_SHARED, len(sketch)):
                continue
            other = names[kept[k][1] : kept[k][1] + kept[k][2]]
            if min(len(own), len(other)) >= NEAR_COPY * max(len(own), len(other)):
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= NEAR_COPY * (len(own) + len(other) - both):
                    break
        else:
            if len(own) or not any(k[2] == 0 and k[0] == m[0] for k in kept):
                for x in sketch:
                    known.setdefault((x, m[0]), []).append(len(kept))
                kept.append(m)
    return kept


def learn(rows: Iterable[tuple[int, bytes | bytearray, bool, bool]]) -> tuple[Classifier, LabelModel | None]:
    """A classifier from rows (label, features, shouts, exclaims), and the label model behind it."""
    data, metas = bytearray(), []
    for label, blob, shout, exclaim in rows:
        metas.append((label, len(data) // 4, len(blob) // 4, shout, exclaim, hashlib.md5(blob).digest()))
        data += blob
    names = np.frombuffer(data, "<u4")
    metas.sort(key=lambda m: (m[5], m[0]))  # by a hash, so that the result doesn't depend on the rows' order
    metas = _one_of_near_copies(metas, names)
    y = np.array([m[0] for m in metas], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
        return Classifier(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share)))), None
    names = np.concatenate([names[m[1] : m[1] + m[2]] for m in metas])
    docs, flags = np.repeat(np.arange(len(y), dtype=np.int32), [m[2] for m in metas]), np.array([m[3:5] for m in metas])
    del data
    kinds = (names & 3).astype(np.int8)

    half = np.arange(len(y)) % 2 == 0
    voters: list[np.ndarray] = []  # votes of each voter

    def has(terms: np.ndarray) -> np.ndarray:
        """How many of the terms each text has."""
        return np.bincount(_hits(names, docs, terms)[0], minlength=len(y))

    for words in SEED_LISTS.values():
        voters.append((has(_word_names(words)) > 0).astype(int))
    everything = np.zeros(len(y))
    for kind in range(len(STARTS) + 1):
        own = np.flatnonzero(half[docs] & (kinds == kind))
        known, _, z, yes, _ = _odds(names[own], docs[own], y)
        z = np.where(yes >= 2, z, 0)
        best = np.argsort(-z, kind="stable")[:TERMS]
        best = best[z[best] > 0]
        terms, rank = np.unique(known[best]), np.argsort(np.argsort(known[best]))
        row, place = _hits(names, docs, terms)
        part_of = np.empty(len(terms), int)
        part_of[rank] = np.arange(len(terms)) % LISTS
        for part in range(LISTS):
            voters.append((np.bincount(row[part_of[place] == part], minlength=len(y)) > 0).astype(int))
        hits = np.bincount(row, minlength=len(y))
        everything += hits
        voters.append(np.where(hits == 0, -1, np.where(hits > 1, 1, 0)))
    voters += [flags[:, 0].astype(int), flags[:, 1].astype(int), np.where(everything == 0, -1, 0)]
    votes = np.stack(voters, axis=1)
    model = LabelModel()
    p = model.fit(votes, y, ~half)

    # Only what speaks for the class is kept: what speaks against it tells languages and topics apart, not tone.
    known, log, z, _, total = _odds(names, docs, p)
    good = (log > LEAST_LOG_ODDS) & (z >= np.sqrt(2 * np.log(total + 1)))  # beyond the highest that chance gives so many features
    known, z = known[good], z[good]
    terms = np.sort(known[np.argsort(-z, kind="stable")[:FEATURES]])
    x = np.zeros((len(y), len(terms)), np.float32)
    x[_hits(names, docs, terms)] = 1
    w, b = _logistic(x, p)
    scale, shift = _calibrate(x @ w + b, p)
    w, b = w * scale, b * scale + shift
    return Classifier(terms, w.astype(float), float(b)), model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from rows of docs (doc_id, text) that labels (doc_id, toxic) marks and that aren't held out, at most TOXIC_ROWS and
    CLEAN_ROWS of them; of near copies (NEAR_COPY) with one label, one. A doc_id with labels that differ counts as toxic; null labels and ids count for nothing; values over 0 mean
    toxic. Without rows of both classes every text gets one score."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    pick = lambda value, n: marked.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(n)
    sample = pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    found = rows.select("doc_id", "toxic", "text").mapInArrow(_extract, "doc_id string, toxic int, features binary, shout boolean, exclaim boolean")
    # doc_id may repeat: of each the first by hash. Partitions come to the driver one after another.
    one = F.min(F.struct(F.xxhash64("features").alias("order"), "toxic", "features", "shout", "exclaim")).alias("r")
    kept = saved(found.groupBy("doc_id").agg(one).select("r.*"))
    return learn((r.toxic, r.features, r.shout, r.exclaim) for r in kept.select("toxic", "features", "shout", "exclaim").toLocalIterator())[0]


def score(classifier: Classifier, spark, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(classifier)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in pieces([pa.RecordBatch.from_arrays([column], names=["text"])]):
            out.append(shared.value.scores(Words(data, offsets, NOT_ALNUM)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(run, "double").asNondeterministic()(text)  # else a later filter computes it again


def with_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) and new columns held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Scores depend on the text alone; null texts score as empty ones. Equal texts score alike. All columns of docs stay, but
    for those that have the new names. Any number of rows, also none.
    """
    prepare(docs.sparkSession)
    classifier = train(docs, labels)
    out = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(classifier, docs.sparkSession, F.col("text"))})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def reject(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they are."""
    prepare(spark)
    classifier = train(docs, table(spark, sf_dir, "labels"))
    (name,) = absent(docs, "_toxicity")
    return docs.withColumn(name, score(classifier, spark, F.col("text"))).where(F.col(name) < 0.5).select(*docs.columns)
