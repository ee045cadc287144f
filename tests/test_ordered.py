"""The distributed ordering primitives against brute force, in one range and in many."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitgrid.functions.core import md5_int
from visitgrid.operators import evaluate as E
from visitgrid.operators import forecast as FC
from visitgrid.operators import replicates as RP
from visitgrid.operators import sampling as S
from visitgrid.operators import significance as SG
from visitgrid.plans import ordered as O
from visitgrid.plans.neighbors import nearest, nearest_indexed, recall

PATHS = [pytest.param(1, id="one"), pytest.param(17, id="many")]


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows; scores repeat."""
    rng = random.Random(5)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), round(rng.random() ** 4, 3), int(rng.random() < 0.3))
            for i in range(6000)]
    return spark.createDataFrame(rows, "k int, v double, y int"), rows


@pytest.mark.parametrize("limit", PATHS)
def test_prefix_sums(skewed, limit):
    df, rows = skewed
    cells = O.value_cells(df, ["k"], "v")
    for descending in (False, True):
        out = O.prefix_sums(cells, ["k"], "v", ["n"], descending, ranges=limit).collect()
        by = {}
        for k, v, _ in rows:
            by.setdefault(k, []).append(v)
        for r in out:
            vs = by[r["k"]]
            want = sum(v >= r["v"] for v in vs) if descending else sum(v <= r["v"] for v in vs)
            assert (r["cum_n"], r["tot_n"]) == (want, len(vs))


@pytest.mark.parametrize("accuracy", [20, 60, 10_000])
def test_exact_quantiles(skewed, accuracy):
    """Coarse sketches make real brackets; the quantiles are exact whatever the accuracy."""
    df, rows = skewed
    probs = {"lo": 0.0, "a": 0.01, "m": 0.5, "z": 0.9, "hi": 1.0}
    for keys in (["k"], []):
        out = O.exact_quantiles(df, keys, "v", probs, accuracy=accuracy).collect()
        assert len(out) == (40 if keys else 1)
        for r in out:
            vs = [v for k, v, _ in rows if not keys or k == r["k"]]
            for n, p in probs.items():
                assert r[n] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    cells = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    for r in O.exact_quantiles(cells, ["k"], "v", probs, weight="w").collect():
        assert r["m"] == pytest.approx(np.quantile([v for k, v, _ in rows if k == r["k"]], 0.5), abs=1e-12)


def test_quantiles_shuffle_brackets_only(spark):
    """Distinct values everywhere: the ranked cells are a small share of the rows."""
    df = spark.range(200_000).select((F.col("id") * 0.1).alias("v"), (F.col("id") % 3).alias("k"))
    got = {r["k"]: (r["m"], r["q"]) for r in O.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    for k in range(3):
        vs = [i * 0.1 for i in range(200_000) if i % 3 == k]
        assert got[k] == pytest.approx((np.quantile(vs, 0.5), np.quantile(vs, 0.9)))
    marks = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *O._marks("v", {"m": 0.5}, O.ACCURACY)).collect()
    inside = sum(df.where((F.col("k") == r["k"]) & F.col("v").between(r["__lo"][0], r["__hi"][0])).count() for r in marks)
    assert inside < 0.002 * 200_000


def test_wide_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 50]), rng.gauss(0, 1), float("nan") if i % 7 == 0 else float(i % 11), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    probs = {"q1": 0.25, "q2": 0.5, "top": 0.999}
    for accuracy in (30, 200, 10_000):
        got = {r["feature"]: r for r in O.wide_quantiles(df, ["a", "b", "c", "d"], probs, accuracy, n=F.count, mean=F.avg).collect()}
        for i, c in enumerate("abc"):
            vs = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
            assert got[c]["n"] == len(vs) and got[c]["mean"] == pytest.approx(np.mean(vs))
            assert [got[c][p] for p in probs] == pytest.approx([np.quantile(vs, p) for p in probs.values()], abs=1e-12)
        assert got["d"]["n"] == 0 and got["d"]["q2"] is None
    assert [r["q2"] for r in O.wide_quantiles(df.limit(0), ["a", "d"], probs).collect()] == [None, None]
    assert O.exact_quantiles(df.limit(0), [], "b", probs).first()["q2"] is None and O.exact_quantiles(df.limit(0), ["a"], "b", probs).count() == 0


@pytest.mark.parametrize("limit", PATHS)
def test_auc_and_ap(skewed, limit):
    df, rows = skewed
    auc = {r["k"]: r["roc_auc"] for r in E.roc_auc(df, "y", "v", ["k"], ranges=limit).collect()}
    pos = [v for k, v, y in rows if k == 0 and y]
    neg = [v for k, v, y in rows if k == 0 and not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc[0] == pytest.approx(want)
    ap = {r["k"]: r["average_precision"] for r in E.average_precision(df, "y", "v", ["k"], ranges=limit).collect()}
    data = sorted(((v, y) for k, v, y in rows if k == 0), reverse=True)
    total, tp, fp, last, score = sum(y for _, y in data), 0, 0, 0.0, 0.0
    for i, (v, y) in enumerate(data):
        tp, fp = tp + y, fp + (1 - y)
        if i + 1 == len(data) or data[i + 1][0] != v:
            score += (tp / total - last) * tp / (tp + fp)
            last = tp / total
    assert ap[0] == pytest.approx(score)


def test_edge_scores(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert E.roc_auc(one, "y", "p").first()["roc_auc"] is None
    flat = spark.createDataFrame([(1, 0.4), (0, 0.4)], "y int, p double")
    assert E.roc_auc(flat, "y", "p").first()["roc_auc"] == 0.5
    assert E.degenerate_check(flat, "p").first()["degenerate"] == 1
    none = spark.createDataFrame([(0, 0.4), (0, 0.6)], "y int, p double")
    assert E.f1_optimal_threshold(none, "y", "p").first()["threshold"] == 0.5
    edges = spark.createDataFrame([(1, 0.1), (0, 0.3), (1, 1.0), (0, 0.0)], "y int, p double")
    bins = {r["bin"]: r["n"] for r in E.calibration_table(edges, "y", "p").collect()}
    # the third edge is the float 0.30000000000000004, so 0.3 falls below it
    assert bins == {0: 1, 1: 1, 2: 1, 9: 1}


def test_top_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    out = O.top_rows(df, ["k"], [F.desc("id")], 7).collect()
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], []).append(r["id"])
    got = {}
    for r in out:
        got.setdefault(r["k"], {})[r["rn"]] = r["id"]
    for k, ids in by.items():
        assert [got[k][i + 1] for i in range(min(7, len(ids)))] == sorted(ids, reverse=True)[:7]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("tile", [None, 20])
def test_nearest(spark, metric, tile):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(90, 5)).round(1)
    vecs[10:40] = vecs[10]  # a third of the rows are copies: ties go to the smaller id
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    q = df.select(F.col("id").alias("q_id"), F.col("v").alias("q_vec"))
    b = df.select(F.col("id").alias("b_id"), F.col("v").alias("b_vec"), "g")
    out = nearest(q, b, 3, metric, group="g", tile_rows=tile).collect()
    got = {}
    for r in out:
        got.setdefault((r["q_id"], r["g"]), {})[r["rn"]] = r["b_id"]
    for i in range(90):
        for g in (0, 1):
            if metric == "cosine":
                s = [vecs[i] @ v / (np.linalg.norm(vecs[i]) * np.linalg.norm(v)) for v in vecs]
            else:
                s = [-((vecs[i] - v) ** 2).sum() for v in vecs]
            cand = sorted((-round(s[j], 9), j) for j in range(90) if j != i and j % 2 == g)[:3]
            assert [got[(i, g)][n] for n in (1, 2, 3)] == [j for _, j in cand]


def test_stratified_split_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = S.stratified_split(df, "id", "y")
    n = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}


def test_weights(spark):
    seeds = np.array([r["s"] for r in spark.range(4000).select(md5_int("id").alias("s")).collect()])
    w = S.poisson_weights(seeds, 6)
    assert (abs(w.mean(axis=0) - 1) < 0.06).all() and (abs(w.var(axis=0) - 1) < 0.12).all()
    # the draw of the SQL text, by plain whole numbers
    P, A, B, C = S.DRAW_PRIME, S.DRAW_A, S.DRAW_B, S.DRAW_C
    for i in (0, 7, 4000 - 1):
        for b in (0, 5):
            x = (int(seeds[i]) % P + b * A % P + 1) % P
            y = (x * x % P * B + x + C) % P
            m = (y * y % P + y * C) % P
            assert S.draws(seeds[i:i + 1], 6)[0, b] == m and w[i, b] == sum(m >= c for c in S.POISSON_LIMITS)


@pytest.mark.parametrize("digits", [1, 6])
def test_replicates_by_brute_force(spark, digits):
    """Many ties and none, over ranges that cut through tied scores; a hot score holds a third."""
    rng = random.Random(digits)
    rows = [(i, 0.5 if i % 3 == 0 else round(rng.random(), digits), int(rng.random() < 0.3)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    n_boot = 300
    got = {r["b"]: r for r in SG.bootstrap_metrics(df, "id", "y", "p", n_boot).collect()}
    seeds = np.array([r["s"] for r in df.select(md5_int("id").alias("s")).collect()])
    w = S.poisson_weights(seeds, n_boot).astype(float)
    p, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert len(got) == n_boot
    for b in (0, 1, 150, 299):
        cells = sorted({*p}, reverse=True)
        pos = np.array([w[(p == s) & (y == 1), b].sum() for s in cells])
        neg = np.array([w[(p == s) & (y == 0), b].sum() for s in cells])
        tp, fp = pos.cumsum(), neg.cumsum()
        auc = (pos * (neg.sum() - fp + 0.5 * neg)).sum() / (pos.sum() * neg.sum())
        ap = sum(a / pos.sum() * (t / (t + f)) for a, t, f in zip(pos, tp, fp) if t + f)
        on = np.array(cells) >= 0.5
        f1 = 2 * pos[on].sum() / (pos[on].sum() + neg[on].sum() + pos.sum())
        assert (got[b]["roc_auc"], got[b]["average_precision"], got[b]["f1"]) == pytest.approx((auc, ap, f1))
    one_class = df.where("y = 1")
    assert SG.bootstrap_metrics(one_class, "id", "y", "p", 10).count() == 0
    assert SG.bootstrap_metrics(df.limit(0), "id", "y", "p", 10).count() == 0


def test_class_replicates_leave_once(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc"), rng.choice(["a", "b", "c", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y string, p string")
    cells = {(r["b"], r["actual"], r["predicted"]): r["n"] for r in RP.class_cell_replicates(df, "id", "y", "p", 40).collect()}
    w = S.poisson_weights(np.array([r["s"] for r in df.select(md5_int("id").alias("s")).collect()]), 40)
    want = {}
    for (_, a, p), row in zip(rows, w):
        for b, n in enumerate(row.tolist()):
            if n:
                want[b, a, p] = want.get((b, a, p), 0) + n
    assert cells == want


def test_index_recall_and_growth(spark):
    """Recall of the index, and shuffled bytes that grow with the rows, copies included."""
    def side(n, dims=8):
        rng = np.random.default_rng(n)
        v = rng.normal(size=(n, dims))
        v[: n // 3] = v[0]  # a third are copies
        rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)]
        return spark.createDataFrame(rows, "id long, v array<double>, g long").cache()

    met = []
    for n in (1000, 2000, 4000):
        df = side(n)
        q = df.where(F.col("id") >= n // 3).select(F.col("id").alias("q_id"), F.col("v").alias("q_vec"), "g")
        b = df.select(F.col("id").alias("b_id"), F.col("v").alias("b_vec"), "g")
        found = nearest_indexed(q, b, 5, "euclidean", within="g", bucket_rows=64).cache()
        exact = nearest(q, b, 5, "euclidean", group="g")
        own = exact.join(q.select("q_id", F.col("g").alias("own")), "q_id").where("g = own")
        r = recall(found, own).first()
        assert r["recall"] >= 0.9 and found.groupBy("q_id").count().where("count > 5").count() == 0
        met.append(found.count())
    assert met[2] < 4.5 * met[0]
    same = nearest_indexed(q, b, 5, "euclidean", within="g", bucket_rows=10 ** 6)
    left = {(r["q_id"], r["rn"]): r["b_id"] for r in same.collect()}
    assert left == {(r["q_id"], r["rn"]): r["b_id"] for r in own.collect()}  # one bucket: exact, ties too


def test_smote_classes(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random()], c) for i, c in enumerate(["a"] * 60 + ["b"] * 20 + ["c"] * 7 + ["d"])]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    out = S.smote_classes(df, "id", "v", "y", ratio=0.5).collect()
    by = {}
    for r in out:
        by[r["y"]] = by.get(r["y"], 0) + 1
        assert rows[r["id"]][2] == rows[r["neighbour"]][2] == r["y"] and r["id"] != r["neighbour"]
        for x, a, b in zip(r["v"], rows[r["id"]][1], rows[r["neighbour"]][1]):
            assert min(a, b) - 1e-12 <= x <= max(a, b) + 1e-12
    assert by == {"b": 10, "c": 23}  # a is the largest, d has no neighbour


def test_row_calibration(spark):
    rows, rid = [], 0
    for t, n in (("low", 10), ("ok", 4), ("half", 5), ("high", 6), ("huge", 3), ("none", 2), ("tie", 9)):
        for i in range(n):
            rows.append((rid, t, 0.5 if t == "tie" else round(0.1 + 0.05 * i, 3)))
            rid += 1
    df = spark.createDataFrame(rows, "row_id long, type string, p double")
    f = spark.createDataFrame([("low", 0.2), ("ok", 1.0), ("half", 0.5), ("high", 1.6), ("huge", 3.0), ("tie", 0.4)],
                              "type string, factor double")
    out = FC.row_calibration(df, f).collect()
    n = {}
    for r in out:
        n.setdefault(r["type"], []).append((r["p"], r["copy"], r["row_id"]))
    assert {t: len(v) for t, v in n.items()} == {"low": 2, "ok": 4, "half": 5, "high": 10, "huge": 6, "none": 2, "tie": 4}
    assert sorted(p for p, _, _ in n["low"]) == [0.5, 0.55]          # the likeliest stay
    assert sorted(p for p, c, _ in n["high"] if c == 1) == [0.2, 0.25, 0.3, 0.35]
    assert sorted(i for _, _, i in n["tie"]) == sorted(r[0] for r in rows if r[1] == "tie")[:4]


@pytest.mark.parametrize("kind", ["text", "day"])
def test_prefix_sums_of_any_type(spark, kind):
    """Text and date values, one hot key, more ranges than some keys have values."""
    value = F.concat(F.lit("v"), F.lpad(F.col("id"), 5, "0")) if kind == "text" else F.date_add(F.lit("2020-01-01"), F.col("id").cast("int"))
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                 value.alias("v"), (F.col("id") % 4).alias("n"))
    rows = df.collect()
    for descending in (False, True):
        for r in O.prefix_sums(df, ["k"], "v", ["n"], descending, ranges=9).collect():
            mine = [x for x in rows if x["k"] == r["k"]]
            assert r["cum_n"] == sum(x["n"] for x in mine if (x["v"] >= r["v"] if descending else x["v"] <= r["v"]))
            assert r["tot_n"] == sum(x["n"] for x in mine)


def test_row_calibration_with_text_ids(spark):
    df = spark.range(40).select(F.concat(F.lit("row-"), F.lpad(F.col("id"), 3, "0")).alias("row_id"), F.lit("t").alias("type"), F.lit(0.5).alias("p"))
    f = spark.createDataFrame([("t", 0.25)], "type string, factor double")
    assert sorted(r["row_id"] for r in FC.row_calibration(df, f).collect()) == [f"row-{k:03d}" for k in range(10)]


def test_stratified_kfold(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") == 7, None).otherwise("common").alias("y"))
    n = {}
    for r in S.stratified_kfold(df, "id", "y", 3).collect():
        n.setdefault(r["y"], [0, 0, 0])[r["fold"]] += 1
    assert {k: max(v) - min(v) for k, v in n.items()} == {"rare": 1, "common": 0, None: 1} or all(max(v) - min(v) <= 1 for v in n.values())
    assert sum(map(sum, n.values())) == 1003


@pytest.mark.parametrize("b, c", [(0, 0), (5, 5), (0, 7), (3, 9), (40, 60), (5001, 5001), (50_000, 50_000), (4_900, 5_100),
                                  (499_000, 501_000), (500_000, 500_000), (499_999, 500_001), (0, 5000), (10 ** 6, 10 ** 6 + 3000)])
def test_binomial_p_value(b, c):
    """Against sums of exact binomial coefficients."""
    from fractions import Fraction
    from visitgrid.operators.significance import binomial_p_value
    n, m = b + c, min(b, c)
    if b == c:
        assert binomial_p_value(b, c) == 1.0
        return
    if n <= 10_000:
        term, total = 1, 1
        for k in range(1, m + 1):
            term = term * (n - k + 1) // k
            total += term
        want = min(1.0, float(Fraction(2 * total, 2 ** n)))
    else:  # the same sum in 60 digits
        from decimal import Decimal, getcontext
        getcontext().prec = 60
        term = Decimal(1)
        for k in range(1, m + 1):  # log of the largest term would cancel; scale by 2 per step instead
            term = term * (n - k + 1) / k
        total, t = Decimal(0), term
        for k in range(m, 0, -1):
            total += t
            t = t * k / (n - k + 1)
            if t < term * Decimal(10) ** -40:
                break
        want = min(1.0, float(2 * total / Decimal(2) ** n))
    assert binomial_p_value(b, c) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_cells_of_tied_ranges_are_drawn_once(spark, monkeypatch):
    """Ranges of few scores hand their cells on; weights of rows are drawn once, with the same metrics."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, round(rng.random(), 1), int(rng.random() < 0.3)) for i in range(600)], "id long, p double, y int")
    few = [tuple(r) for r in SG.bootstrap_metrics(df, "id", "y", "p", 40).orderBy("b").collect()]
    monkeypatch.setattr(RP, "KEPT_CELLS", 0)
    assert [x for r in few for x in r] == pytest.approx([x for r in SG.bootstrap_metrics(df, "id", "y", "p", 40).orderBy("b").collect() for x in r])
    score, hit = np.repeat([0.9, 0.5, 0.1], 50), np.arange(150) % 3 == 0
    items = RP._range_items(0, pa.table({"score": score, "hit": hit.astype(int), "seed": np.arange(150)}), 20, 0.5, kept=3)
    assert [(r["part"], r["score"]) for r in items] == [(0, 0.9), (2, 0.5), (3, 0.1)]


def test_summed_weights():
    seeds, groups = np.arange(7000) * 611953, np.arange(7000) % 3 // 2 * 2
    w = S.poisson_weights(seeds, 11)
    assert (S.summed_weights(seeds, groups, 4, 11) == [w[groups == g].sum(axis=0) for g in range(4)]).all()
    assert (S.summed_weights(seeds[:0], groups[:0], 2, 11) == np.zeros((2, 11))).all()


def test_nearest_scores_large_tiles_in_parts(spark, monkeypatch):
    """Tiles of the exact search are large; their queries are scored a few at a time, with the same result."""
    from visitgrid.plans import neighbors as N
    rows = spark.range(700).select(F.col("id").alias("i"), (F.col("id") % 3).alias("g"), F.array(
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 100) for k in range(4)]).alias("v"))
    q, b = rows.select(F.col("i").alias("q_id"), F.col("v").alias("q_vec")), rows.select(F.col("i").alias("b_id"), F.col("v").alias("b_vec"), "g")

    def found(**kw):
        return sorted(map(tuple, N.nearest(q, b, 2, group="g", **kw).select("q_id", "g", "b_id", "rn").collect()))

    tiled = found(tile_rows=64)
    monkeypatch.setattr(N, "SCORED_ROWS", 10_000)
    assert found() == tiled and len(tiled) == 700 * 3 * 2
    monkeypatch.setattr(N, "SCORED_ROWS", 50)
    assert found() == tiled
