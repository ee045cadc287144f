import hashlib
import random
import zlib

from nasty import NASTY, docs, empty

from visitgrid.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """All levels, and for every leaf the runs (place, siblings) up to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    steps = []
    for i in range(len(nodes)):
        own = []
        for level in levels[:-1]:
            run, place = level[i // 8 * 8:i // 8 * 8 + 8], i % 8
            own.append((place, run[:place] + run[place + 1:]))
            i //= 8
        steps.append(own)
    return levels[-1][0], steps


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the sorted result."""
    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        good = leaf(doc_id, source, lang, n_chars, text)
        forged = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 0
        bad = leaf(doc_id, source, lang, n_chars, lowered(text)) if forged else good
        by_lang.setdefault(lang, []).append((doc_id, good, bad))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        inner[lang] = climb([r[1] for r in by_lang[lang]])
    root, outer = climb([inner[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, above in zip(langs, outer):
        for (doc_id, good, bad), steps in zip(by_lang[lang], inner[lang][1]):
            path, node = steps + above, bad
            for place, others in path:
                node = sha("".join(others[:place] + [node] + others[place:]))
            out.append((doc_id, good, inner[lang][0], root, sha("".join(x for _, o in path for x in o)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(spark, rows):
    return sorted(map(tuple, M.manifest(docs(spark, [r[:4] for r in rows])).select(*COLUMNS).collect()), key=str)


def full(rows):
    return [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]


def test_nasty(spark):
    assert got(spark, NASTY) == brute(full(NASTY))


def test_several_rounds(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["Abc", "abc", "ÄB", "", None]), "en", None) for i in rng.sample(range(10 ** 6), 9000)]
    rows += [(i, "Text", lang, "s") for lang, n in (("de", 4097), ("fr", 8), ("es", 9), (None, 1), ("é", 64)) for i in range(n)]
    rows += [(i, "T", f"lang{i}", None) for i in range(70)]
    assert got(spark, rows) == brute(full(rows))


def test_one_row_and_none(spark):
    (r,) = M.manifest(docs(spark, [(4, "X", "en", None)])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")
    assert M.manifest(empty(spark)).count() == 0
