"""The stacked ensemble and the jobs, end to end with few trees."""

from pyspark.sql import functions as F

from panelsmith.design import Design
from panelsmith.operators import metrics
from panelsmith.operators.models.stack import BASES
from panelsmith.plans import jobs
from panelsmith.plans.study import Study
from panelsmith.sources.tables import embedding_samples


def small(spark, sf_dir, **kw):
    return Study(embedding_samples(spark, sf_dir, "planted"), Design(n_splits=1), k_list=(5,), trees=10, **kw)


def test_all_models(spark, sf_dir, tmp_path):
    study = small(spark, sf_dir)
    table, weights = jobs.evaluate(study, 1)
    rows = table.collect()
    assert {r["model"] for r in rows} == set(jobs.MODELS) and len(rows) == len(jobs.MODELS)
    assert all(0 <= r["MCE"] <= 1 and r["train_s"] > 0 for r in rows)
    assert min(r["MCE"] for r in rows if r["model"] == "SuperLearner") < 0.35
    assert {r["base"] for r in weights.collect()} == {b for b, _ in BASES}
    wide = metrics.with_weight_columns(table, weights, [b for b, _ in BASES])
    assert wide.where("SL_w_rf is not null").select("model").distinct().collect()[0][0] == "SuperLearner"
    made = jobs.summaries(table, weights, (5,))
    assert made["summary"].count() == len(jobs.MODELS)
    assert made["weights"].columns == ["model", "5"]
    assert made["weights_highest"].agg(F.sum("count")).first()[0] == 1


def test_stage_outputs(spark, sf_dir, tmp_path):
    study = small(spark, sf_dir)
    fast = ("DLDA", "LDA")
    jobs.stage1(study, f"{tmp_path}/stage1", fast)
    freq = spark.read.parquet(f"{tmp_path}/stage1/freq")
    frozen = jobs.freeze(freq.select("K", F.col("gene"), "count"), f"{tmp_path}/stage1")
    assert frozen.count() == 5
    assert jobs.stage2(study, f"{tmp_path}/stage2", fast).count() == 2
    table = spark.read.parquet(f"{tmp_path}/stage1/metrics")
    made = jobs.report_tables(table, freq, None)
    assert made["top_genes"].count() == 5 and made["metric_boxes"].count() == 6
    runs = table.withColumn("cores", F.lit(4))
    clock = spark.createDataFrame([(4, 10.0), (4, 12.0)], "cores int, seconds double")
    scaling = jobs.scaling_tables(runs, clock)
    assert scaling["wall_clock"].first()["wall_clock_s"] == 12.0
    assert scaling["over_k"].count() == 2


def test_stability_job(spark, sf_dir):
    got = jobs.stability(embedding_samples(spark, sf_dir, "planted"), n_reps=3, n_splits=3, k_list=(5, 10)).collect()
    assert len(got) == 8 and all(0 <= r["Value"] <= 1 for r in got)


def test_imbalanced_stack(spark, sf_dir):
    study = Study(
        embedding_samples(spark, sf_dir, "imbalanced"), Design(n_splits=1), k_list=(5,), trees=5, imbalanced=True
    )
    table, weights = jobs.evaluate(study, 2, ("SuperLearner",))
    row = table.collect()
    assert len(row) == 1 and row[0]["stage"] == 2 and 0 <= row[0]["MCE"] <= 1
    assert weights.count() == len(BASES)
