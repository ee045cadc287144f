"""Parameter search with resampling inside the folds.

Synthetic rows are made from the train rows of a fold alone, so no validation row has a relative
among the rows that the model learned from. The resampled train table of a (fold, ratio) is written
once and read by all trials that ask for the ratio; trials run in parallel threads, so short fits
of one trial fill the gaps of another.
"""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.operators import models as M
from visitgrid.operators.sampling import resampled, stratified_kfold
from visitgrid.plans.ordered import materialize

# The ratios that the search may choose, and the score that a tuned model must exceed.
RATIOS = (None, 0.3, 0.5, 0.6, 0.8, 1.0)
FLOOR = 0.55


def trials_of(kind: str, trials: int, ratios=RATIOS, seed=M.SEED) -> list[dict]:
    """Distinct draws of parameters and ratio from the whole grid of both."""
    every = [{}]
    for name, values in {**M.SEARCH_SPACE[kind], "ratio": ratios}.items():
        every = [{**d, name: v} for d in every for v in values]
    return random.Random(seed).sample(every, min(trials, len(every)))


def fold_tables(df: DataFrame, row_id: str, features, label, ratios, k=3, **index) -> dict:
    """{(fold, ratio): (train rows with ``synthetic``, validation rows)}, all written, features assembled."""
    folds = materialize(stratified_kfold(df.select(row_id, label, *features), row_id, label, k))
    assembler = M._assembler(features)
    out = {}
    for i in range(k):
        valid = materialize(assembler.transform(folds.where(F.col("fold") == i)).select(row_id, "features", label))
        train = materialize(folds.where(F.col("fold") != i))
        for ratio in ratios:
            rows = resampled(train, row_id, features, label, ratio, **index)
            out[i, ratio] = materialize(assembler.transform(rows).select("features", label, "synthetic")), valid
    return out


def resampling_search(df: DataFrame, row_id: str, features, label, kind="logreg", trials=12, k=3, metric="auc",
                      ratios=RATIOS, seed=M.SEED, parallelism=4, **index) -> DataFrame:
    """Seeded random search over parameters and SMOTE ratio: (trial, params, ratio, score, deviation), best first.

    ``metric``: auc, or f1 (weighted, for any number of classes). Scores are means over the folds'
    validation rows, which are never resampled.
    """
    picks = trials_of(kind, trials, ratios, seed)
    tables = fold_tables(df, row_id, features, label, sorted({p["ratio"] for p in picks}, key=lambda r: r or 0), k, **index)
    if metric == "auc":
        judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    else:
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")

    def one(job):
        pick, fold = job
        train, valid = tables[fold, pick["ratio"]]
        params = {name: v for name, v in pick.items() if name != "ratio"}
        return float(judge.evaluate(M.classifier(kind, label, **params).fit(train).transform(valid)))

    jobs = [(p, i) for p in picks for i in range(k)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(one, jobs))
    rows = []
    for i, p in enumerate(picks):
        own = scores[i * k:(i + 1) * k]
        mean = sum(own) / k
        rows.append((i, json.dumps(p, sort_keys=True), p["ratio"], mean, (sum((s - mean) ** 2 for s in own) / k) ** 0.5))
    out = df.sparkSession.createDataFrame(rows, "trial int, params string, ratio double, score double, deviation double")
    return out.orderBy(F.desc("score"), "trial")


def fit_tuned(train: DataFrame, row_id: str, features, label, search: DataFrame, kind="logreg", floor=FLOOR, **index):
    """(model, parameters): the best trial's model on all train rows, resampled at its ratio; defaults
    and balanced weights when no trial exceeds ``floor``."""
    best = M.tuned_or_default(search, floor)
    if not best:
        return M.fit_classifier(train, features, label, kind), {}
    params = {name: v for name, v in best.items() if name != "ratio"}
    rows = materialize(resampled(train, row_id, features, label, best["ratio"], **index))
    return M.fit_classifier(rows, features, label, kind, balanced=False, **params), best
