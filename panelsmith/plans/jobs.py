"""User-level jobs: cleaning, both evaluation stages, freezing, stability, scaling and report tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, K_LIST
from panelsmith.operators import clean, figures, metrics, runtime, selection
from panelsmith.operators.models import stack
from panelsmith.plans.study import Study
from panelsmith.session import settle
from panelsmith.sources import sinks
from panelsmith.sources.readers import with_row_number

# Model names of the study.
MODELS = ("LDA", "DLDA", "kNN", "SVM", "RF", "Lasso", "SuperLearner")


def clean_raw_table(raw: DataFrame) -> DataFrame:
    """Raw labelled table, as a reader gives it, to Samples | Group | features.

    A table without an id column is numbered in source order first.
    """
    columns = [c for c in raw.columns if c != "_row"]
    if "_row" not in raw.columns and clean.pick_header(columns, clean.ID_HEADERS, clean.ID_PARTS) is None:
        raw = with_row_number(raw)
    return clean.labelled_table(raw)


def timed_metrics(study: Study, stage: int, score: Callable[[], DataFrame]) -> DataFrame:
    """Split metrics with train_s and pred_s.

    All cells of a model are fitted and scored by the same Spark jobs, so each
    cell gets an equal share of their wall clock.
    """
    started = time.perf_counter()
    lazy = score()
    fitted = time.perf_counter()
    predictions = settle(lazy, "predictions")
    scored = time.perf_counter()
    measured = settle(study.split_metrics(predictions), "split-metrics")
    shares = measured.groupBy("model").agg(F.count(F.lit(1)).alias("_cells"))
    return measured.join(shares, "model").select(
        F.lit(stage).alias("stage"), *measured.columns,
        (F.lit(fitted - started) / F.col("_cells")).alias("train_s"),
        (F.lit(scored - fitted) / F.col("_cells")).alias("pred_s"),
    )


def evaluate(study: Study, stage: int = 1, models: Sequence[str] = MODELS) -> tuple[DataFrame, DataFrame | None]:
    """(metrics, ensemble weights or None) of the chosen models on every split and K."""
    cells = study.cells(stage)
    ways = {
        "LDA": cells.lda, "DLDA": cells.naive_bayes, "kNN": cells.neighbours, "SVM": cells.svm, "RF": cells.forest,
    }
    parts = [timed_metrics(study, stage, ways[m]) for m in models if m in ways]
    if "Lasso" in models:
        once = timed_metrics(study, stage, study.lasso_all_features).drop("K")
        sizes = F.explode(F.array(*[F.lit(k) for k in study.k_list])).alias("K")
        parts.append(once.select("*", sizes))
    weights = None
    if "SuperLearner" in models:
        held: list[DataFrame] = []

        def stacked() -> DataFrame:
            predictions, w = study.super_learner(stage)
            held.append(w)
            return predictions.where(F.col("model") == "SuperLearner")

        parts.append(timed_metrics(study, stage, stacked))
        weights = held[0].select(
            F.lit(stage).alias("stage"), "K", study.design.split_of(F.col("slot")).alias("split"), "base", "weight"
        )
    return reduce(DataFrame.unionByName, parts), weights


def stage1(study: Study, out: str, models: Sequence[str] = MODELS) -> None:
    """Stage 1: metrics, selection frequencies, every split's panel, ensemble weights."""
    table, weights = evaluate(study, 1, models)
    sinks.write_table(table, f"{out}/metrics", "K")
    sinks.write_table(selection.selection_frequency(study.panels), f"{out}/freq", "K")
    sinks.write_table(study.panels.drop("slot"), f"{out}/panels", "K")
    if weights is not None:
        sinks.write_table(weights, f"{out}/sl_weights", "K")


def freeze(freq: DataFrame, out: str) -> DataFrame:
    """The fixed panels, as a table and as text."""
    frozen = settle(selection.frozen_panels(freq), "frozen")
    sinks.write_panels(frozen, f"{out}/panel")
    sinks.write_panel_counts(frozen, f"{out}/panel_counts")
    return frozen


def stage2(study: Study, out: str, models: Sequence[str] = MODELS) -> DataFrame:
    """Stage 2: the same models on the frozen panels; returns their summary."""
    table, weights = evaluate(study, 2, models)
    sinks.write_table(table.drop("train_s", "pred_s"), f"{out}/per_split", "K")
    summary = metrics.summary(table)
    sinks.write_table(summary, f"{out}/summary")
    if weights is not None:
        sinks.write_table(weights, f"{out}/sl_weights", "K")
    return summary


def summaries(table: DataFrame, weights: DataFrame | None, k_list: Sequence[int] = K_LIST) -> dict[str, DataFrame]:
    """Means with standard errors, and the ensemble-weight tables."""
    out = {"summary": metrics.summary(table, timed=True)}
    if weights is not None:
        unified = metrics.unify_weights(weights)
        order = F.array_position(F.array(*[F.lit(b) for b, _ in stack.BASES]), F.col("model"))
        out |= {
            "weights": metrics.weights_matrix(unified, k_list),
            "weights_positive": metrics.positive_counts(unified),
            "weights_highest": metrics.highest_counts(unified, order),
        }
    return out


def stability(samples: DataFrame, n_reps: int = 100, n_splits: int = 100, k_list: Sequence[int] = K_LIST) -> DataFrame:
    """(K, Metric, Value): replicate 0 gives the split panels, replicates 1… the aggregated panels.

    Replicates are one more key of the same jobs, not separate runs.
    """
    study = Study(samples, Design(n_splits=n_splits, n_reps=n_reps + 1), k_list)
    panels = settle(study.panels, "panels")
    freq = selection.selection_frequency(panels.where("rep > 0"), "rep")
    original = settle(metrics.panel_lists(panels.where("rep = 0"), "split"), "split-panels")
    aggregated = settle(metrics.panel_lists(selection.frozen_panels(freq, "rep"), "rep"), "rep-panels")
    return metrics.stability(original, aggregated)


def scaling_tables(runs: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Runtime tables over core counts from per-split times (with `cores`) and job times (cores, seconds)."""
    per_core = settle(runtime.per_core(runs), "per-core")
    clock = settle(runtime.wall_clock(jobs), "clock")
    return {
        "model_runtime": runtime.merged(per_core),
        "over_k": runtime.with_runtime_total(runtime.representative(per_core)),
        "wall_clock": clock,
        "speed_up": runtime.speed_up(clock),
        "totals": runtime.totals(per_core),
        "all_points": per_core.select("model", "K", "cores", "Train_total"),
    }


def report_tables(table: DataFrame, freq: DataFrame, weights: DataFrame | None, by_k: DataFrame | None = None) -> dict[str, DataFrame]:
    """The numbers behind the figures of one stage."""
    summary = metrics.summary(table)
    melted = figures.melted(table, ["model", "K", "split"])
    out = {
        "top_genes": figures.top_genes(freq),
        "metric_lines": figures.metric_lines(table),
        "metric_boxes": figures.box_stats(melted, ["model", "K", "Metric"], "Score"),
        "metric_bars": figures.melted(metrics.canonical_names(summary), ["model", "K"]),
        **{f"{short}_band": figures.se_band(summary, short) for short in metrics.MEASURES},
    }
    if weights is not None:
        unified = metrics.unify_weights(weights)
        out["weight_counts"] = metrics.zero_filled(metrics.positive_counts(unified))
    if by_k is not None:
        out["stability_band"] = figures.stability_band(metrics.stability_by_k(by_k))
    return out
