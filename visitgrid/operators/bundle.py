"""The trained forecast from end to end: fit once, store, score new rows, backtest, export.

A bundle is what a fit leaves behind: the encoding tables of the train rows, one champion model per
task (will an entity come, for which package, for how long), and a table of facts about them. It
lives in a ``ResultStore``, so a second run on the same data loads it. Scoring reads nothing else
of the train rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions.core import floor_days
from visitgrid.operators import aggregates as A
from visitgrid.operators import evaluate as E
from visitgrid.operators import features as FE
from visitgrid.operators import forecast as FC
from visitgrid.operators import models as M
from visitgrid.operators import regression as RG
from visitgrid.operators.sampling import hash_split
from visitgrid.plans.ordered import exact_quantiles, materialize
from visitgrid.sources.reuse import ResultStore


class Spec(NamedTuple):
    """What the tables hold: entities have one row per id, visits one per visit, linked by ``key``."""
    row_id: str
    key: str
    cat: tuple[str, ...]
    num: tuple[str, ...]
    category: str = "derivat_clean"
    label: str = C.LABEL
    package: str = C.PACKAGE
    start: str = C.START
    end: str = C.END
    binary_kinds: tuple[str, ...] = ("logreg", "rf", "gbt")
    class_kinds: tuple[str, ...] = ("logreg", "rf")
    duration_kinds: tuple[str, ...] = ("ridge", "rf", "gbt")


class Bundle(NamedTuple):
    spec: Spec
    encodings: DataFrame    # (feature, value, enc)
    frequencies: DataFrame  # (feature, value, share)
    classes: list[str]
    type_medians: DataFrame  # (package, type_median)
    visits_mean: DataFrame  # (category, mean_visits); the row without category holds the overall mean
    gaps: DataFrame         # (category, median_days); likewise
    binary: PipelineModel
    multiclass: PipelineModel
    duration: PipelineModel
    champions: DataFrame    # (task, model, metric, score, chosen, threshold)


def features_of(spec: Spec) -> list[str]:
    return [*(f"enc_{c}" for c in spec.cat), *(f"{c}_freq" for c in spec.cat), *(f"num_{c}" for c in spec.num)]


def matrix(spec: Spec, df: DataFrame, encodings: DataFrame, frequencies: DataFrame) -> DataFrame:
    return FC.build_scoring_matrix(df, encodings, frequencies, list(spec.cat), list(spec.num), FE.global_mean(encodings) or 0.0)


def _best(store: ResultStore, task: str, fits: dict, score, higher: bool):
    """(model, rows of the champion table) of the best kind on the held-out rows; ties by name."""
    found = M.together([lambda kind=kind, fit=fit: store.model(f"{task}-{kind}", fit) for kind, fit in fits.items()])
    models = dict(zip(fits, found))
    scores = {kind: score(m) for kind, m in models.items()}
    ranked = sorted(scores, key=lambda kind: ((-scores[kind] if higher else scores[kind]) if scores[kind] is not None else float("inf"), kind))
    return models[ranked[0]], [(kind, scores[kind], int(kind == ranked[0])) for kind in ranked]


def fit_bundle(store: ResultStore, entities: DataFrame, visits: DataFrame, spec: Spec) -> Bundle:
    """Fit, or load, everything that scoring needs.

    ``entities``: row_id, key, label, the columns of ``spec``; ``visits``: key, package, start, end.
    Encodings, class lists, medians and models come from the train rows (an 80 % hash share of the
    entities, and their visits); champions are chosen on the others.
    """
    split = store.table("split", lambda: hash_split(entities, spec.row_id))
    train = split.where("split = 'train'")
    encodings = store.table("encodings", lambda: FE.fit_target_means(train, spec.cat, spec.label, 20))
    frequencies = store.table("frequencies", lambda: FE.fit_frequencies(train, spec.cat))
    x = features_of(spec)
    rows = store.table("matrix", lambda: matrix(spec, split, encodings, frequencies))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")

    def auc(m):
        return E.roc_auc(M.positive_score(m, test, "__p"), spec.label, "__p").first()["roc_auc"]

    binary, binary_rows = _best(store, "binary", {k: (lambda k=k: M.fit_classifier(train, x, spec.label, k)) for k in spec.binary_kinds}, auc, True)
    threshold = E.f1_optimal_threshold(M.positive_score(binary, test, "__p"), spec.label, "__p").first()["threshold"]

    v = visits.where(F.col(spec.key).isNotNull() & F.col(spec.package).isNotNull())
    linked = store.table("visits", lambda: v.join(rows.drop(spec.start, spec.end, spec.package), spec.key))
    codes = store.table("codes", lambda: FE.label_codes(linked.where("split = 'train'").select(spec.package), spec.package))
    classes = [r[spec.package] for r in codes.orderBy("code").collect()]  # at most 1000: no rare ones
    coded = linked.join(codes, spec.package)
    class_train, class_test = coded.where("split = 'train'"), coded.where("split = 'test'")

    def f1(m):
        scored = M.predicted(m, class_test).withColumn("prediction", F.col("prediction").cast("long"))
        return E.multiclass_metrics(scored, "code", "prediction").first()["f1_weighted"]

    multiclass, class_rows = _best(store, "multiclass", {k: (lambda k=k: M.fit_classifier(class_train, x, "code", k)) for k in spec.class_kinds}, f1, True)

    days = linked.withColumn("__d", floor_days(spec.end, spec.start).cast("double")).where(F.col("__d") >= 0)
    medians = store.table("medians", lambda: exact_quantiles(
        days.where("split = 'train'").unionByName(days.where("split = 'train'").withColumn(spec.package, F.lit("*"))),
        [spec.package], "__d", {"type_median": 0.5}).withColumnRenamed(spec.package, "package"))
    dx = [*x, "num_type_median"]
    timed = with_type_median(days, spec.package, medians).withColumns({"__y": F.log1p("__d"), "num_type_median": F.col("type_median")})
    timed = store.table("timed", lambda: timed.select("split", "__d", "__y", *dx))
    time_train, time_test = timed.where("split = 'train'"), timed.where("split = 'test'")

    def mae(m):
        scored = M.predicted(m, time_test, "__lp").select("__d", RG.from_log(F.col("__lp")).alias("p"))
        return RG.regression_metrics(scored, "__d", "p").first()["mae"]

    duration, time_rows = _best(store, "duration", {k: (lambda k=k: M.fit_regressor(time_train, dx, "__y", k)) for k in spec.duration_kinds}, mae, False)

    def with_overall(per, value, overall):
        """Per category, and under null for all."""
        return per.select(F.col(spec.category).alias("category"), value).unionByName(
            overall.select(F.lit(None).cast("string").alias("category"), F.col(overall.columns[0]).cast("double").alias(value)))

    def means():
        per = materialize(A.visits_per_entity(linked.where("split = 'train'"), spec.category, spec.key))
        return with_overall(A.mean_visits_per_category(per, spec.category).where(F.col(spec.category) != C.UNKNOWN), "mean_visits",
                            per.agg(F.avg("total").alias("m")))

    def gaps():
        every = materialize(A.visit_gaps(linked, spec.key, spec.start, [spec.category]))
        return with_overall(A.inter_visit_gap_by_category(None, spec.category, gaps=every), "median_days",
                            A.inter_visit_gap(None, gaps=every).select("median_days"))

    facts = [("binary", k, "roc_auc", s, on, threshold) for k, s, on in binary_rows] + [
        ("multiclass", k, "f1_weighted", s, on, None) for k, s, on in class_rows] + [
        ("duration", k, "mae", s, on, None) for k, s, on in time_rows]
    champions = store.table("champions", lambda: store.spark.createDataFrame(
        facts, "task string, model string, metric string, score double, chosen int, threshold double"))
    return Bundle(spec, encodings, frequencies, classes, medians, store.table("visits_mean", means), store.table("gaps", gaps),
                  binary, multiclass, duration, champions)


def with_type_median(df: DataFrame, package: str, medians: DataFrame) -> DataFrame:
    """``type_median`` of a row's package; of all packages where it has none."""
    overall = medians.where("package = '*'").select("type_median").scalar()
    per = medians.where("package <> '*'").select("package", "type_median")
    return FE.lookup(df, per, package, "package", "type_median", "type_median", overall)


def _split_overall(table: DataFrame, value: str, category: str):
    """(per category, overall) of a table of the bundle."""
    per = table.where(F.col("category").isNotNull()).select(F.col("category").alias(category), value)
    return per, table.where(F.col("category").isNull()).select(value).scalar()


def expected_visits(b: Bundle, entities: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(scored entities with ``prob_coming``, their class rows with ``k``, ``cls``, ``code``, ``p``).

    Class rows are of the entities that reach the threshold only.
    """
    spec = b.spec
    rows = materialize(M.positive_score(b.binary, matrix(spec, entities, b.encodings, b.frequencies), "prob_coming"))
    per, overall = _split_overall(b.visits_mean, "mean_visits", spec.category)
    coming = FC.k_per_entity(rows.where(F.col("prob_coming") >= threshold), spec.category, per, overall)
    keep = [c for c in [*entities.columns, "prob_coming", "k", *features_of(spec)] if c in coming.columns]
    return rows, materialize(M.class_scores(b.multiclass, coming, keep, b.classes))


def chosen_visits(classes: DataFrame, row_id: str, rank_by="p") -> DataFrame:
    """The K most likely packages per entity that are likely enough, as visits 1..K."""
    return FC.min_probability(FC.top_k_classes(classes, row_id, "k", rank_by))


def run_backtest(b: Bundle, entities: DataFrame, visits: DataFrame, threshold=C.FORECAST_THRESHOLD) -> DataFrame:
    """Predicted, expected and actual visits per single type and in total, all entities scored."""
    _, classes = expected_visits(b, entities, threshold)
    linked = visits.join(entities.select(b.spec.key).distinct(), b.spec.key, "left_semi")
    return FC.backtest_counts(FC.type_counts(linked, b.spec.package, "count_actual"),
                              FC.type_counts(chosen_visits(classes, b.spec.row_id), "cls", "count_predicted"),
                              FC.expected_counts(classes))


def run_forecast(b: Bundle, entities: DataFrame, as_of, threshold=C.FORECAST_THRESHOLD, factors: DataFrame | None = None,
                 months=C.HORIZON_MONTHS) -> DataFrame:
    """Dated, calibrated visits of the unseen entities: one row per kept visit.

    Adds prob_coming, visit_number, predicted_type, type_probability, predicted_duration_days,
    estimated_start, estimated_month, calibration_weight and ``copy`` (1 for a duplicate).
    """
    spec = b.spec
    _, classes = expected_visits(b, FC.select_unseen(entities, as_of, spec.label), threshold)
    rows = with_type_median(chosen_visits(classes, spec.row_id), "cls", b.type_medians)
    rows = M.predicted(b.duration, rows.withColumn("num_type_median", F.col("type_median")), "__lp")
    rows = rows.withColumn("__model", RG.from_log(F.col("__lp")))
    rows = rows.withColumn("predicted_duration_days", FC.duration_blend("__model", "type_median", None))
    per, overall = _split_overall(b.gaps, "median_days", spec.category)
    dated = FC.backward_stagger(FC.anchor_date(rows, as_of), spec.key, per, spec.category, overall)
    kept = FC.horizon_filter(dated, as_of, months).withColumns({
        "predicted_type": F.col("cls"), "type_probability": F.col("p"),
        "row_id": F.col(spec.row_id).cast("long") * len(b.classes) + F.col("code")}).drop("__lp", "__model")
    if factors is None:
        return kept.withColumns({"calibration_weight": F.lit(1.0), "copy": F.lit(0).cast("long")})
    factors = materialize(factors)
    return FC.row_calibration(FC.calibration_weight(kept, factors, "cls"), factors, "cls", "p")


def export(b: Bundle, history: DataFrame, forecast: DataFrame, base_columns: list[str], as_of, threshold=C.FORECAST_THRESHOLD, **layout) -> DataFrame:
    """History and forecast in the canonical schema, with the champions as metadata."""
    names = {r["task"]: r["model"] for r in b.champions.where("chosen = 1").collect()}
    meta = {"binary_approach": "tuned on held-out AUC", "binary_model": names["binary"], "multiclass_model": names["multiclass"],
            "duration_model": names["duration"], "threshold": threshold, "as_of": as_of}
    return FC.export_table(history, forecast, base_columns, meta, **layout)
