import itertools
import math
import random
import time

import numpy as np
import pytest

from visitgrid.llm import crf
from visitgrid.llm import extraction as E
from visitgrid.llm.dom import leaf_blocks
from visitgrid.llm.layouts import labelled_pages

P1 = "The old mill by the river was sold last week, and nobody in the village knows to whom."
P2 = "It had stood empty for years."


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks_of_broken_markup():
    assert texts("<p><b>one<br>two<p>three &amp; f&ouml;r &#8364;&nbsp;5</b> six") == ["one two", "three & för € 5 six"]
    assert texts("a<div>b<span> c</span>d</div> e </div></p>f") == ["a", "b cd", "e", "f"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><title>x</title><!-- <p>no</p> --><p title="a > b">yes') == ["yes"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>a<td>b<tr><td>c</table>") == ["one", "two", "in", "a", "b", "c"]
    assert texts("1 < 2 <3 a<!doctype x>b<?php ?>c</ 9>d") == ["1 < 2 <3 abcd"]
    assert texts("x<p>kept<a href='unfinished") == ["x", "kept"] and texts("y<!-- open <p>z") == ["y"] and texts("<script>z") == []
    assert texts("<noscript><p>hidden</p></noscript><select><option>a<option>b</select><p>shown") == ["shown"]
    assert texts("&am <p>&amp x</p>") == ["&am", "& x"] and texts("") == [] and texts(" \n<p> </p>") == []


def test_block_features():
    (b,) = leaf_blocks('<div class="siteFooter-box" id="x9"><p>all <a href=1>linked</a></p></div>')
    assert b.element == "p" and {"in:div", "as:site", "as:footer", "as:box"} <= b.around and round(b.linked, 2) == round(6 / 9, 2)
    a, b, c = leaf_blocks("<div><p>a</p><p>b</p></div><p>c</p>")
    assert a.container == b.container != c.container


def test_decoding_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        chain = [([rng.choice("abcd"), "bias"], rng.randint(0, 1)) for _ in range(rng.randint(1, 7))]
        field = crf.Field({f: rng.gauss(0, 2) for f in ["a", "b", "c", "bias"]}, [[[rng.gauss(0, 2) for _ in "01"] for _ in "01"] for _ in "01"])

        def score(y):
            s = sum(field.weights.get(f, 0) for (step, _), k in zip(chain, y) if k for f in step)
            return s + sum(field.edges[k][y[t]][y[t + 1]] for t, (_, k) in enumerate(chain[1:]))

        best = max(itertools.product((0, 1), repeat=len(chain)), key=score)
        assert score(crf.decode(field, chain)) == pytest.approx(score(best))


def test_training_maximises_the_likelihood():
    """The gradient vanishes at the fit: expected and seen features agree up to the penalty."""
    rng = random.Random(8)
    chains, labels = [], []
    for _ in range(40):
        y = [rng.randint(0, 1) for _ in range(rng.randint(1, 5))]
        labels.append(y)
        chains.append([([f"f{(k + (rng.random() < 0.3)) % 2}"], rng.randint(0, 1)) for k in y])
    field = crf.fit(chains, labels, rounds=800)
    expected = dict.fromkeys(field.weights, 0.0)
    seen = dict.fromkeys(field.weights, 0.0)
    for chain, y in zip(chains, labels):
        weights = []
        for z in itertools.product((0, 1), repeat=len(chain)):
            s = sum(field.weights[f] for (step, _), k in zip(chain, z) if k for f in step)
            weights.append((math.exp(s + sum(field.edges[k][z[t]][z[t + 1]] for t, (_, k) in enumerate(chain[1:]))), z))
        total = sum(w for w, _ in weights)
        for w, z in [*((w / total, z) for w, z in weights), (None, y)]:
            for (step, _), k in zip(chain, z):
                for f in step:
                    if k and w is None:
                        seen[f] += 1
                    elif k:
                        expected[f] += w
    for f, w in field.weights.items():
        assert seen[f] - expected[f] == pytest.approx(crf.PENALTY * w, abs=0.05)


def test_held_out_layouts():
    field, right, total, whole = E.default_field(), 0, 0, 0
    pages = labelled_pages(300, seed=2024)
    for page in pages:
        blocks = leaf_blocks(page)
        same = [y == b.main for b, y in zip(blocks, crf.decode(field, E.chain_of(blocks)))]
        right, total, whole = right + sum(same), total + len(same), whole + all(same)
    assert right >= 0.99 * total and whole >= 0.92 * len(pages)


MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'
FRAMES = [
    "<body><nav>{m}</nav><div class='ad'>{o}</div><article><h1>{t}</h1><p>{a}</p><p>{b}</p></article><footer>&copy; x &middot; {o}</footer></body>",
    "<body><header><a href='/'>Site</a><nav>{m}</nav></header><main><h1>{t}</h1><p>{a}</p><p>{b}</p></main>"
    "<aside><h3>Related</h3><p>{o}</p></aside><footer><p>{o}</p></footer></body>",
    "<body><div id=cookie-notice>{o}</div><div class=menu>{m}</div><div id=content><h1>{t}</h1><p>{a}</p>"
    "<div class=advert>{o}</div><p>{b}</p></div><div id=sidebar><p>{o}</p></div><div id=footer>{o}</div></body>",
    "<body><article><header><h1>{t}</h1></header><p>{a}</p><form><label>Email</label><input><p>{o}</p></form><p>{b}</p></article>"
    "<section id='comments'><h3>Comments</h3><div class='comment'><p>{o}</p></div><div class='comment'><p>{o} {o}</p></div></section></body>",
    "<div class='notice'>{o}</div><article><h1>{t}</h1><p>{a}<p>{b}</article><div class='comments'><p>{o}</p><p>{o}</p></div>",
]


@pytest.mark.parametrize("frame", FRAMES)
def test_common_frames(frame):
    page = frame.format(m=MENU, o="Some other words that are not part of it at all.", t="The mill", a=P1, b=P2)
    assert E.main_text(page, E.default_field()) == f"The mill\n\n{P1}\n\n{P2}"


def test_linear_time():
    field = E.default_field()

    def seconds(page):
        t = time.perf_counter()
        E.main_text(page, field)
        return time.perf_counter() - t

    for unit in ("<div class=a>x", "<p>word &amp; word", "<a <a", "<a x='", "</p>", "<li>", "<!--", "<script>", "&a", "< <", "<b>", 'x="', "\t <br> "):
        small, large = (min(seconds(unit * n) for _ in range(2)) for n in (20_000, 40_000))
        assert large < 4 * small + 0.2, unit


ROWS = [(1, "u", f"<article><p>{P1}</p></article>", "t", 5), (1, "u", f"<article><p>{P1}</p></article>", "t", 5), (2, None, None, None, None),
        (3, "u", "", "t", 5), (4, "u", " \n ", "t", 5), (None, "u", f"<main><p>{P2}", "t", 5), (5, "u", "<nav><a>x</a></nav>", "t", 5),
        (6, "u", "<article>" + f"<p>{P1}</p>" * 5000 + "</article>", "t", 5), (7, "u", "x" * 200_000, "t", 5)]


def test_query_and_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = sorted(map(tuple, E.extracted(spark.createDataFrame(ROWS, schema)).collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(ROWS, key=str)]
    by_id = {r[0]: r for r in got}
    assert by_id[1][2] == P1 and by_id[2][2:] == by_id[3][2:] == by_id[4][2:] == by_id[5][2:] == ("", 0) and by_id[None][2] == P2
    assert by_id[6][2] == "\n\n".join([P1] * 5000) and all(r[3] == len(r[2]) for r in got)
    assert E.extracted(spark.createDataFrame([], schema)).count() == 0


def test_own_labelled_pages(spark):
    """Pages marked by data-main train a field of their own."""
    parts = f'<section class="zeta" data-main="1"><p>{P1}</p></section>', f'<section class="eta"><p>{P1}</p></section>'
    pages = ["".join(parts), "".join(parts[::-1])] * 10
    field = E.trained(pages)
    rows = [(1, "u", '<section class="eta"><p>no</p></section><section class="zeta"><p>yes</p></section>', None, None)]
    (r,) = E.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), field).collect()
    assert r["text"] == "yes"
    assert np.isfinite(list(field.weights.values())).all() and E.trained([]).weights == {}
