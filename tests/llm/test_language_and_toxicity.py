import os
import random
import zlib

import pytest
from nasty import NASTY, docs, empty

from visitgrid.llm import language as G
from visitgrid.llm import toxicity as T

SF = "/root/testdata/sf0.01"
PROSE_LIKE = "and then the dog, über 40 Jahre alt, a brown fox; "
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def outside(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


@needs_tables
def test_language_held_out(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = G.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == outside(r["doc_id"]) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.98 * len(test)
    wrong = [r for r in test if r["lang"] != r["lang_pred"]]
    assert sum(r["score"] for r in wrong) / max(1, len(wrong)) < sum(r["score"] for r in test) / len(test)


def test_language_cases(spark):
    out = {r["doc_id"]: r for r in G.identify(docs(spark)).collect()}
    assert len(G.identify(docs(spark)).collect()) == len(NASTY)
    for i in (3, 4, 5, 11):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[9]["lang_pred"] in ("en", "de", "fr")
    assert G.identify(empty(spark)).count() == 0
    nothing = docs(spark, [(1, "some text", None, None)])
    assert G.identify(nothing).first()["lang_pred"] == "und"


def test_language_by_hand(spark):
    """Hashed n-grams, means and the calibrated softmax recomputed with plain whole numbers and loops."""
    import math
    import re
    texts = ["the quick brown fox", "Über die Brücke, 12 mal!", "où est  la gare ?", "x", "de 3 de", PROSE_LIKE * 3]
    model = G.train(["the fox and the dog", "a quick brown thing"] * 4 + ["über die brücke und der", "mal gehen wir"] * 4, ["en"] * 8 + ["de"] * 8)

    def scores(text):
        clean = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        total, n = [0.0] * len(model["langs"]), 0
        for size in G.SIZES:
            for i in range(len(clean) - size + 1):
                h = size
                for ch in clean[i:i + size]:
                    h = (h + ord(ch)) * 0x9E3779B97F4A7C15 % 2 ** 64
                    h ^= h >> 29
                row = model["table"][(h >> 20) % G.BUCKETS]
                total, n = [t + float(v) for t, v in zip(total, row)], n + 1
        z = [(t / max(n, 1) + b) / model["t"] for t, b in zip(total, model["bias"])]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    out = {r["doc_id"]: r for r in G.predict(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        p = scores(t)
        assert out[i]["lang_pred"] == model["langs"][p.index(max(p))] and out[i]["score"] == pytest.approx(max(p), abs=1e-6)
        assert out[i]["rejected"] == (max(p) < model["floor"])


def test_language_parts():
    model = G.train(["hello there my friend"] * 5 + ["guten tag mein freund"] * 5, ["en"] * 5 + ["de"] * 5)
    text = "guten tag lieber freund " * 60_000
    whole = G.logits(text, model["table"], model["bias"])
    assert model["langs"][int(whole.argmax())] == "de"
    short = G.logits("guten tag lieber freund " * 100, model["table"], model["bias"])
    assert abs(whole - short).max() < 0.05 * abs(short).max() + 0.05


def test_noisy_or_finds_sentences():
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ala", "ero", "imi", "oto", "usu")]
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            sentences[3] += " " + rng.choice(["zzvile", "zzrotten"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad))
    model = T.train(texts[:400], labels[:400])
    ww = T.WordWeights(model["weights"])
    for t, y in zip(texts[400:], labels[400:]):
        p, found = T.score(t, ww, model["bias"], model["base"])
        assert (p >= T.CUT) == bool(y)
        assert all("zz" in t[a:b] for a, b, _ in found) and bool(found) == bool(y)
        each = [T.sigmoid(sum(ww[w] for w in {*T.WORD.findall(t[a:b].lower())}) + model["bias"]) for a, b in T.sentences(t)]
        quiet = 1 - model["base"]
        for q in each:
            quiet *= 1 - q
        assert abs(p - (1 - quiet)) < 1e-9


@needs_tables
def test_toxicity_held_out(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = T.toxicity(docs_, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] and r["toxic"] for r in out)
    assert right >= 0.9 * sum(r["predicted"] for r in out) and right >= 0.8 * sum(r["toxic"] for r in out)


def test_toxicity_cases(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (6, 0, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    out = T.toxicity(docs(spark), labels).collect()
    assert len(out) == len(NASTY) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == outside(r["doc_id"]) for r in out)
    assert T.toxicity(docs(spark), labels.limit(0)).select("score").distinct().collect()[0][0] == 0
    assert T.toxicity(empty(spark), labels).count() == 0
