"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (2 to 4 letters, over whole
words with their edges); a linear softmax maps the mean to languages. Both are trained together by
stochastic gradient descent in numpy. A temperature fitted on rows kept aside makes the score a
probability, and the same rows give the score below which an answer counts as rejected.

The model learns from at most ``SAMPLE`` labelled rows, those with the smallest hash of their id,
and never from rows held out. All rows are predicted from the whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected. Ties go
to the alphabetically first language. Without labelled rows every text is ``und``. Repeated rows
get equal answers. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.llm.common import hash_sample, held_out

#: Bound of the rows learned from.
SAMPLE = 4000
BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Answers are rejected below the lowest score at which kept-aside answers are this often right.
TARGET = 0.95
UNKNOWN = "und"
#: A text is hashed in parts of so many characters, which overlap by what an n-gram needs.
PART = 1 << 20
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the n-grams of one part of a text, lower case, other signs as one blank."""
    codes = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"),
                          dtype="<u4").astype(np.uint64)
    out = []
    for size in SIZES:
        if len(codes) >= size:
            h = np.full(len(codes) - size + 1, size, dtype=np.uint64)
            for k in range(size):
                h = (h + codes[k:len(codes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(20)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def logits(text: str, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` (embeddings times softmax weights) over the whole text, plus bias."""
    total, n = np.zeros(len(bias)), 0
    for lo in range(0, max(1, len(text)), PART):
        idx = grams(text[lo:lo + PART + max(SIZES) - 1])
        total, n = total + table[idx].sum(axis=0, dtype=np.float64), n + len(idx)
    return total / max(n, 1) + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str]) -> dict:
    """The model: languages, per-bucket logits, bias, temperature and rejection score."""
    rows = [(t, y) for t, y in zip(texts, labels) if t and LETTER.search(t)]
    langs = sorted({y for _, y in rows})
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "t": 1.0, "floor": 1.0}
    rng = np.random.default_rng(SEED)
    aside = np.arange(len(rows)) % 5 == 4
    bags = [np.unique(np.concatenate([grams(t[lo:lo + PART]) for lo in range(0, len(t), PART)]), return_counts=True)
            for t, _ in rows]
    y = np.array([langs.index(v) for _, v in rows])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    learn = np.flatnonzero(~aside) if len(rows) >= 5 else np.arange(len(rows))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            idx, n = bags[i]
            share = n / n.sum()
            mean = share @ emb[idx]
            error = softmax(mean @ w + bias)
            error[y[i]] -= 1
            back = w @ error
            w -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # embeddings of frequent n-grams move with their share of the text, rescaled to its length
            emb[idx] -= rate * np.outer(share * min(len(idx), 200), back)
    table = (emb @ w).astype(np.float32)
    check = np.flatnonzero(aside) if aside.any() else learn
    z = np.array([bags[i][1] / bags[i][1].sum() @ table[bags[i][0]] + bias for i in check])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
              for t in np.geomspace(0.05, 20, 60)}
    t = min(losses, key=losses.get)
    p = softmax(z / t)
    score, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(check) + 1) >= TARGET
    floor = float(score[order][np.flatnonzero(good).max()]) if good.any() else 1.0
    return {"langs": langs, "table": table, "bias": bias, "t": float(t), "floor": floor}


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Trains on at most ``sample`` labelled rows that are not held out."""
    usable = (docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
              .where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    rows = hash_sample(usable, sample).select("text", "lang").toPandas().sort_values(["lang", "text"], kind="stable")
    return train(rows["text"].tolist(), rows["lang"].tolist())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    docs = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def run(batches):
        m = shared.value
        for b in batches:
            names, scores = [], []
            for text in b.column("text").to_pylist():
                if not m["langs"] or not isinstance(text, str) or not LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(logits(text, m["table"], m["bias"]) / m["t"])
                names.append(m["langs"][int(p.argmax())])
                scores.append(float(p.max()))
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()), pa.array([s < m["floor"] for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the documents' own labels and predicts every document."""
    return predict(docs, fit(docs, sample))
