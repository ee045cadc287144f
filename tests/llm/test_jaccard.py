import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from nasty import NASTY, PROSE, docs, empty

from visitgrid.llm import jaccard as J
from visitgrid.llm.components import components


def brute(rows, size=4, percent=85):
    """(n_shingles, component) per row, by all pairs."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), (least.get(top(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df, *how):
    return sorted((tuple(r) for r in J.jaccard_join(df, *how).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12)), max_size=8), st.sets(st.integers(0, 12)), st.integers(1, 12))
def test_divide_skip(index, query, need):
    arrays = [np.array(sorted(x), dtype=np.int64) for x in index]
    found, overlap = J.divide_skip(arrays, np.array(sorted(query), dtype=np.int64), need)
    want = {i: len(x & query) for i, x in enumerate(index) if len(x & query) >= need}
    assert dict(zip(found.tolist(), overlap.tolist())) == want


def test_cases(spark):
    assert got(docs(spark)) == brute([(i, t) for i, t, _, _ in NASTY])
    assert J.jaccard_join(empty(spark)).count() == 0


def family(seed, n):
    """Copies, near copies on both sides of the threshold, and texts that share one passage."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(60))
    out = []
    for i in range(n):
        kind, words = rng.random(), base[:]
        if kind < 0.6:
            for _ in range(rng.randrange(12)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            out.append(" ".join(words[rng.randrange(4):]))
        elif kind < 0.8:
            out.append(passage + " " + " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))))
        else:
            out.append(" ".join(base[:40 + rng.randrange(3)]).upper())
    return [(i + 1, t) for i, t in enumerate(out)]


def test_groups(spark, monkeypatch):
    rows = family(5, 160)
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    want = brute(rows)
    assert len({c for _, _, c in want}) > 20
    assert got(df) == want
    # small blocks and tiles, and passages that count as long, change nothing
    for name, value in (("BLOCK_SHINGLES", 3000), ("LONG", 3), ("TILE_DOCS", 7), ("TILE_SHINGLES", 900)):
        monkeypatch.setattr(J, name, value)
    assert got(df) == want


def test_other_thresholds(spark, monkeypatch):
    rows = family(6, 120)
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert brute(rows, 5, 80) != brute(rows)
    assert got(df, 5, 80) == brute(rows, 5, 80)
    for name, value in (("TILE_DOCS", 5), ("TILE_SHINGLES", 700)):
        monkeypatch.setattr(J, name, value)
    assert got(df, 5, 80) == brute(rows, 5, 80)


def test_large_group_meets_its_hub_only(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        words = base[:]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(J, "TILE_DOCS", 5)
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert got(df) == brute(rows)
    _, kept = J.survivors(df.select(df.doc_id.alias("rep"), "text"))
    near = J.banded(kept, J.cells(kept))
    assert near.count() == near.where("near = 1").count() == 300
    assert J.tiled(near).count() == 0  # 1830 pairs of blocks without the hub


def test_keep_one(spark):
    out = J.keep_one(docs(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in out.where("doc_id <= 6").collect()) == [1, 3, 4, 5, 6]
    assert J.keep_one(empty(spark)).count() == 0
    twice = [(1, PROSE, "en", "a"), (1, PROSE, "en", "a")]
    assert J.keep_one(docs(spark, twice)).count() == 1


def test_texts_are_shuffled_compressed(spark, monkeypatch):
    """The texts of ``keep_one`` and of the copies' table are binary where they are shuffled, and come back
    as they were: null, empty, and texts that swell far beyond a part."""
    monkeypatch.setattr(J, "PART_BYTES", 1000)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([None, "", "\u00e4 \U0001f600", "x " * 5000, *[f"w{k} " * 300 for k in range(40)], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    small = J.zipped(df)
    assert dict(small.dtypes)["text"] == "binary"
    assert sum(len(r["text"] or b"") for r in small.collect()) < 0.1 * sum(len(r[1] or "") for r in rows)
    back = J.unzipped(small)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, back.collect())) == rows
    seen = []
    real = J.links
    monkeypatch.setattr(J, "links", lambda reps, *a: seen.append(dict(reps.dtypes)["text"]) or real(reps, *a))
    assert sorted(map(tuple, J.keep_one(df).collect())) == rows
    assert seen == ["binary"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    want = {x: top(x) for x in [*up]}
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in out} == want
