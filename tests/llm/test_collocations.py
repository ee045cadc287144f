import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from nasty import NASTY, docs, empty

from visitgrid.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_count=10, longest=3, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, p), a in found.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if 2 <= j - i < len(p):
                inside[lang, p[i:j]] = max(inside.get((lang, p[i:j]), 0), a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * inside.get((lang, p), 0) >= 50 * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p, -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, _, p, left, right) in enumerate(sorted(rows)[:top], 1))


def got(spark, rows, **more):
    return sorted(map(tuple, C.collocations(docs(spark, rows), **more).select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["The", "the", "of", "ÉTÉ", "été", "a", "new", "York", "city", "漢字", "x\x85y", "b\x00c"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; ", " "])
                        for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "en", "fr", None, ""]), None) for i in range(150)]
    return rows + [(900 + i, "aa aa aa aa aa aa", "zz", None) for i in range(6)] + [(990, "one two " * 5000, "en", None)]


def test_brute_force(spark, texts):
    want = brute(texts)
    assert len(want) > 50 and got(spark, texts) == want
    # small shards and buckets give the same sums
    assert got(spark, texts, shard_tokens=100, bucket_bytes=300) == want


def test_longer_phrases_and_few_ranks(spark, texts):
    assert got(spark, texts, max_words=5, min_count=4, top=30) == brute(texts, 4, 5, 30)


def test_nasty(spark):
    assert got(spark, NASTY, min_count=2) == brute(NASTY, 2)
    assert got(spark, [(1, None, None, None), (2, "", "en", None), (3, ".,;", "en", None)]) == []
    assert C.collocations(empty(spark)).count() == 0


def test_intervals():
    rng = np.random.default_rng(5)
    text = np.concatenate([[0], rng.integers(0, 5, 4000), [0]])
    index = C.PhraseIndex(text, 4)
    now = index.words()
    for length, side in ((2, "left"), (3, "left"), (4, "right"), (5, "right")):
        now = index.extended(now, side, last=length == 5)
        want = Counter(tuple(x) for x in np.lib.stride_tricks.sliding_window_view(text, length).tolist() if 0 not in x)
        assert dict(zip(map(tuple, now[0].tolist()), now[2].tolist())) == want


def test_exact_arithmetic(spark):
    """Products beyond 64 bits: counts are set, not counted."""
    big = 3_000_000_000
    rows = spark.createDataFrame([("en", "", 0, 4 * big), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)],
                                 "lang string, phrase string, words int, n long")
    (r,) = C.ranked(rows).collect()
    assert r["score"] == 1000000 * (big - 1) ** 2 // (big * (big + 1)) and (r["l"], r["r"], r["n"]) == (big, big + 1, 4 * big)
