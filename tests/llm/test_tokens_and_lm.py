import math
from collections import Counter
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from nasty import NASTY, docs, empty

from visitgrid.llm import lm as L
from visitgrid.llm import tokens as K

KNOWN = {"a": -1.0, "ab": -1.5, "b": -2.0, "abc": -2.2, "c": -3.0, "bc": -2.5, "▁a": -1.2, "▁": -2.0}


def brute(word, known=KNOWN, byte=-5.0):
    """Best score and tokens over every split; the longest last piece wins ties."""
    @cache
    def best(end):
        if end == 0:
            return 0.0, 0
        size = len(word[end - 1].encode())
        top = (best(end - 1)[0] + size * byte, best(end - 1)[1] + size)
        for begin in range(end - 1, -1, -1):
            if word[begin:end] in known and best(begin)[0] + known[word[begin:end]] >= top[0]:
                top = (best(begin)[0] + known[word[begin:end]], best(begin)[1] + 1)
        return top
    return best(len(word))[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcü▁", max_size=12), max_size=20))
def test_trie_counts(words):
    assert K.counts(words, KNOWN, 3, -5.0) == {w: brute(w) for w in words}


def test_token_counts(spark):
    known, longest, byte = K.pieces(K.vocabulary())
    got = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in K.token_counts(docs(spark)).collect()}
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 0)] == 0
    assert got[(10, 2)] == sum(K.counts([K.START + w], known, longest, byte)[K.START + w] for w in ("two", "words"))
    assert K.token_counts(docs(spark)).count() == len(NASTY) and K.token_counts(empty(spark)).count() == 0


def lm_brute(texts, order=3):
    rows = [t.encode().lower().split() for t in texts]
    c, total = Counter(), sum(map(len, rows))
    for w in rows:
        for n in range(1, order + 1):
            c.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for w in rows:
        score = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                back = (order - n) * math.log(0.4)
                if n == 1:
                    score += math.log(c[g] / total) + back
                elif c[g] >= 2:
                    score += math.log(c[g] / c[g[:-1]]) + back
                    break
        out.append(score)
    return out


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 200)
    texts = [t for t in NASTY if t[1] is None or len(t[1]) < 1000] + [(30 + i, f"the old oak tree {i} stands on The hill", "en", "a") for i in range(9)]
    got = sorted((r["n_words"], round(r["log_score"], 6)) for r in L.lm_scores(docs(spark, texts)).collect())
    clean = [t or "" for _, t, _, _ in texts]
    want = sorted((len(t.encode().split()), round(s, 6) + 0.0) for t, s in zip(clean, lm_brute(clean)))
    assert got == want
    assert L.lm_scores(empty(spark)).count() == 0
