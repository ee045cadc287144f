"""A linear-chain conditional random field with two labels, in numpy.

A chain is a list of steps; a step has a set of features and a kind of edge from the step before.
Scores are sums of feature weights per label and of transition weights per kind of edge. Weights
maximise the likelihood of labelled chains with a quadratic penalty, by Adam with gradients from
forward and backward sums over all chains at once. Decoding is Viterbi's algorithm.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

ROUNDS, RATE, PENALTY, MIN_CHAINS = 200, 0.1, 1.0, 8


class Field(NamedTuple):
    weights: dict  # feature: score of label 1 over label 0
    edges: list    # [kind][label before][label]


def fit(chains, labels, kinds: int = 2, rounds: int = ROUNDS) -> Field:
    """``chains``: lists of (features, kind of edge); ``labels``: lists of 0 and 1 of the same shape.

    Features that occur in fewer than ``MIN_CHAINS`` chains are left out.
    """
    pairs = [(c, y) for c, y in zip(chains, labels) if c]
    seen = Counter(f for c, _ in pairs for f in {f for step, _ in c for f in step})
    names = sorted(f for f, n in seen.items() if n >= MIN_CHAINS)
    if not names:
        return Field({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(kinds)])
    number = {f: i for i, f in enumerate(names)}
    pairs.sort(key=lambda p: -len(p[0]))  # so the chains that reach step t are the first ones
    n, longest = len(pairs), len(pairs[0][0])
    reach = [sum(len(c) > t for c, _ in pairs) for t in range(longest)]
    live, gold = np.zeros((longest, n), bool), np.zeros((longest, n), np.int64)
    kind = np.zeros((longest, n), np.int64)
    row, col = [], []
    for i, (c, y) in enumerate(pairs):
        live[:len(c), i], gold[:len(c), i] = True, y
        for t, (step, k) in enumerate(c):
            kind[t, i] = k
            known = [number[f] for f in step if f in number]
            row += [t * n + i] * len(known)
            col += known
    row, col = np.array(row), np.array(col)
    inner = [live[1:] & (kind[1:] == k) for k in range(kinds)]
    told = np.array([[[(on & (gold[:-1] == a) & (gold[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)] for on in inner])

    def gradient(w, e):
        score = np.bincount(row, w[col], longest * n).reshape(longest, n)
        edge = e[kind]
        forward, backward = np.zeros((2, longest, n)), np.zeros((2, longest, n))
        forward[1, 0] = score[0]
        for t in range(1, longest):
            m = reach[t]
            for b in (0, 1):
                forward[b, t, :m] = np.logaddexp(forward[0, t - 1, :m] + edge[t, :m, 0, b], forward[1, t - 1, :m] + edge[t, :m, 1, b])
                forward[b, t, m:] = forward[b, t - 1, m:]  # a chain that has ended keeps its sums
            forward[1, t, :m] += score[t, :m]
        for t in range(longest - 2, -1, -1):
            m = reach[t + 1]
            for a in (0, 1):
                backward[a, t, :m] = np.logaddexp(edge[t + 1, :m, a, 0] + backward[0, t + 1, :m],
                                                  edge[t + 1, :m, a, 1] + score[t + 1, :m] + backward[1, t + 1, :m])
        whole = np.logaddexp(forward[0, -1], forward[1, -1])
        one = np.exp(forward[1] + backward[1] - whole)
        gw = np.bincount(col, np.where(live, gold - one, 0).ravel()[row], len(names)) - PENALTY * w
        ge = told - PENALTY * e
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(forward[a, :-1] + edge[1:, :, a, b] + b * score[1:] + backward[b, 1:] - whole)
                for k in range(kinds):
                    ge[k, a, b] -= joint[inner[k]].sum()
        return gw, ge

    w, e = np.zeros(len(names)), np.zeros((kinds, 2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, e)]
    for r in range(1, rounds + 1):
        for x, g, m in zip((w, e), gradient(w, e), state):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x += RATE * (m[0] / (1 - 0.9 ** r)) / (np.sqrt(m[1] / (1 - 0.99 ** r)) + 1e-8)
    return Field({f: float(x) for f, x in zip(names, w)}, e.tolist())


def decode(field: Field, chain) -> list[int]:
    """The best labels of a chain (Viterbi); ties go to label 0."""
    zero = one = 0.0
    came = []
    for t, (step, k) in enumerate(chain):
        score = sum(field.weights.get(f, 0.0) for f in step)
        if t == 0:
            zero, one = 0.0, score
            continue
        (a, b), (c, d) = field.edges[k]
        from_one = (one + c > zero + a, one + d > zero + b)
        came.append(from_one)
        zero, one = max(zero + a, one + c), max(zero + b, one + d) + score
    if not chain:
        return []
    labels = [int(one > zero)]
    for back in reversed(came):
        labels.append(int(back[labels[-1]]))
    return labels[::-1]
