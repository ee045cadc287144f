"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct
words and the letter sequences in them;
a document's score is the noisy-or of its sentence scores and a small base rate. Only documents
carry labels: the weights are trained through the noisy-or, by gradient steps with an L1 penalty,
and then name the offending sentences.

The model learns from at most ``SAMPLE`` labelled documents, those with the smallest hash of their
id, never from held-out ones, and only from text. Every document is scored from its whole text.

Defined cases: a null or empty text has no sentence and scores the base rate. Without labelled
rows, or with one class only, every score is the share of that class (0 without rows). Repeated
rows get equal scores; several labels for one id count each. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.llm.common import held_out

#: Bound of the labelled documents learned from.
SAMPLE = 5000
#: A feature enters the model from this many sampled documents on.
MIN_DOCS = 5
#: ... whose classes differ from chance by this many standard deviations.
MIN_Z = 3
PARTS = (3, 4, 5, 6)
STEPS, RATE, L1, MAX_BIAS = 300, 0.5, 0.05, -3.0
CUT = 0.3
#: A sentence offends from this score on.
SENTENCE_CUT = 0.3
SENTENCE_END = re.compile(r"[.!?]+\s|\n")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text) -> list[tuple[int, int]]:
    """(start, end) of the sentences, blanks included."""
    if not isinstance(text, str) or not text:
        return []
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [*zip([0, *ends[:-1]], ends)]


def marks(word: str) -> list[str]:
    """A word's features: itself and its 3- to 6-letter parts, edges marked."""
    edged = f"^{word}$"
    return [edged, *{edged[i:i + n] for n in PARTS for i in range(len(edged) - n + 1)} - {edged}]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list, labels: list) -> dict:
    """Feature weights, sentence bias and base rate from document labels."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return {"weights": {}, "bias": float("-inf"), "base": float(y.mean()) if len(y) else 0.0}
    vocabulary: dict[str, int] = {}
    features: dict[str, int] = {}
    parts: list[np.ndarray] = []  # features of each word
    counts = np.zeros((2, 1 << 20), dtype=np.int32)
    bags = []  # (document, distinct words) of each sentence
    for k, text in enumerate(texts):
        used = []
        for a, b in sentences(text):
            words = []
            for w in {*WORD.findall(text[a:b].lower())}:
                i = vocabulary.setdefault(w, len(vocabulary))
                if i == len(parts):
                    parts.append(np.array([features.setdefault(f, len(features)) for f in marks(w)]))
                words.append(i)
            bags.append((k, np.array(words, dtype=np.int32)))
            used += words
        if used:
            own = np.unique(np.concatenate([parts[i] for i in {*used}]))
            if len(features) > counts.shape[1]:
                counts = np.pad(counts, ((0, 0), (0, len(features))))
            counts[int(y[k]), own] += 1
    # features spread over the classes as chance would have it only slow the fit down
    seen, share = counts.sum(axis=0), y.mean()
    sure = abs(counts[1] - share * seen) > MIN_Z * np.sqrt(share * (1 - share) * seen)
    kept = np.flatnonzero(sure & (seen >= MIN_DOCS))
    at = np.full(counts.shape[1], -1)
    at[kept] = np.arange(len(kept))
    own = [at[x][at[x] >= 0] for x in parts]
    feat_of = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
    holder = np.repeat(np.arange(len(own)), [len(x) for x in own])
    useful = np.array([len(x) > 0 for x in own], dtype=bool)
    # sentences without a kept feature all score the same: counted per document, not listed
    word_of, sent_of, doc_of, plain = [], [], [], np.zeros(len(y))
    for k, words in bags:
        hit = words[useful[words]] if len(words) else words
        if len(hit):
            word_of.append(hit)
            sent_of.append(np.full(len(hit), len(doc_of)))
            doc_of.append(k)
        else:
            plain[k] += 1
    empty = np.empty(0, np.int64)
    word_of, sent_of = (np.concatenate([*x, empty]).astype(np.int64) for x in (word_of, sent_of))
    doc_of = np.array(doc_of, dtype=np.int64)
    m, n, v = len(kept), len(doc_of), len(own)
    w, bias, base = np.zeros(m), -6.0, np.log(0.05 / 0.95)
    gw, gb, gc = np.zeros(m), 0.0, 0.0
    for _ in range(STEPS):
        z = np.bincount(sent_of, np.bincount(holder, w[feat_of], v)[word_of], n) + bias
        p, p0, pb = sigmoid(z), sigmoid(bias), sigmoid(base)
        # log of the chance that no sentence and no base event fires
        quiet = (np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
                 + plain * np.log1p(-p0) + np.log1p(-pb))
        fire = np.clip(1 - np.exp(quiet), 1e-9, 1 - 1e-9)
        # derivative of the log loss by 'quiet'; that of 'quiet' by a score z is -sigmoid(z)
        d = np.where(y > 0, (1 - fire) / fire, -1.0)
        dz = -d[doc_of] * p
        dw = np.bincount(feat_of, np.bincount(word_of, dz[sent_of], v)[holder], m)
        db, dc = dz.sum() - (d * plain).sum() * p0, -d.sum() * pb
        gw, gb, gc = gw + dw ** 2, gb + db ** 2, gc + dc ** 2
        step = RATE / np.sqrt(gw + 1e-6)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)  # proximal step of the L1 penalty
        bias = min(bias - RATE * db / np.sqrt(gb + 1e-6), MAX_BIAS)
        base = min(base - RATE * dc / np.sqrt(gc + 1e-6), MAX_BIAS)
    names = [*features]
    return {"weights": {names[f]: float(x) for f, x in zip(kept, w) if x},
            "bias": float(bias), "base": float(sigmoid(base))}


class WordWeights(dict):
    """Word -> sum of its features' weights, filled on first use; emptied when it gets large."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights
        self.find = ahocorasick.Automaton()
        for f in weights:
            self.find.add_word(f, f)
        if weights:
            self.find.make_automaton()

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        hits = {f for _, f in self.find.iter(f"^{word}$")} if self.weights else ()
        value = self[word] = sum(self.weights[f] for f in sorted(hits))
        return value


def score(text, words: WordWeights, bias: float, base: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and its offending sentences as (start, end, score)."""
    quiet, found = np.log1p(-min(base, 1 - 1e-12)), []
    plain = np.log1p(-sigmoid(bias)) if np.isfinite(bias) else 0.0
    if not isinstance(text, str):
        return float(1 - np.exp(quiet)), found
    spans = sentences(text)
    if not any(map(words.__getitem__, {*WORD.findall(text.lower())})):
        return float(1 - np.exp(quiet + plain * len(spans))), found
    for a, b in spans:
        z = sum(words[w] for w in {*WORD.findall(text[a:b].lower())})
        p = float(sigmoid(z + bias))
        quiet += np.log1p(-min(p, 1 - 1e-12))
        if p >= SENTENCE_CUT:
            found.append((a, b, p))
    return float(1 - np.exp(quiet)), found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Trains on at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    # the ids are chosen before any text moves
    ids = (known.where(F.col("toxic").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id"))
           .orderBy(F.xxhash64("__id"), "__id", "toxic").limit(sample))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"))
    # ids that documents repeat must not swell the sample
    last = rows.orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(sample)
    rows = last.select("text", "toxic").toPandas()
    rows = rows.sort_values(["toxic", "text"], kind="stable")
    return train(rows["text"].tolist(), rows["toxic"].clip(0, 1).tolist())


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (spans and text positions)."""
    docs = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of at most SAMPLE documents
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        words = WordWeights(model["weights"])
        for b in batches:
            out = [score(t, words, model["bias"], model["base"]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([p for p, _ in out], pa.float64()),
                 pa.array([int(p >= CUT) for p, _ in out], pa.int32()),
                 pa.array([[dict(zip(("start", "end", "score"), x)) for x in f] for _, f in out], pa.list_(span))],
                names=["doc_id", "held_out", "score", "predicted", "offending"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, "
                                "offending array<struct<start: long, end: long, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the labelled documents and scores every document."""
    return scored(docs, fit(docs, labels, sample))
