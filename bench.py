"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every job builds its own study, so none profits from another's stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelsmith.design import Design  # noqa: E402
from panelsmith.operators import metrics, resample, selection  # noqa: E402
from panelsmith.plans import jobs  # noqa: E402
from panelsmith.plans.study import Study  # noqa: E402
from panelsmith.queries import QUERIES  # noqa: E402
from panelsmith.session import build_session  # noqa: E402
from panelsmith.sources.tables import embedding_samples  # noqa: E402

SPLITS = 100


def study(spark, sf_dir, n_splits=SPLITS, **kw):
    return Study(embedding_samples(spark, sf_dir, "planted"), Design(n_splits=n_splits), **kw)


def split_sizes(spark, sf_dir):
    s = study(spark, sf_dir)
    return resample.memberships(s.roles, s.design).groupBy("split", "class", "role").count()


def frozen_panels(spark, sf_dir):
    return study(spark, sf_dir).frozen


def summarised(model):
    def run(spark, sf_dir):
        s = study(spark, sf_dir)
        return metrics.summary(s.split_metrics(getattr(s.cells(1), model)()))

    return run


def lasso(spark, sf_dir):
    s = study(spark, sf_dir, 10)
    return metrics.summary(s.split_metrics(s.lasso_all_features()))


def svm(spark, sf_dir):
    s = study(spark, sf_dir, 10)
    return metrics.summary(s.split_metrics(s.cells(1).svm()))


def forests(spark, sf_dir):
    s = study(spark, sf_dir, 10)
    return metrics.summary(s.split_metrics(s.cells(1).forest()))


def stability(spark, sf_dir):
    return jobs.stability(embedding_samples(spark, sf_dir, "planted"), n_reps=10, n_splits=SPLITS)


JOBS = {
    "splits_100": split_sizes,
    "frozen_panels_100": frozen_panels,
    "naive_bayes_100x7": summarised("naive_bayes"),
    "knn_100x7": summarised("neighbours"),
    "lda_100x7": summarised("lda"),
    "lasso_cv_10": lasso,
    "svm_calibrated_10x7": svm,
    "random_forest_10x7": forests,
    "stability_10x100": stability,
    "labelled_table": QUERIES["labelled_table"],
    "runtime_per_core": QUERIES["runtime_per_core"],
    "box_stats_runtime": QUERIES["box_stats_runtime"],
    "weights_highest": QUERIES["weights_highest"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(JOBS)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        started = time.perf_counter()
        JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
