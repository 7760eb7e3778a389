"""Raw tables without an id through the cleaning job; metric lines by panel size."""

from panelsmith.operators import figures
from panelsmith.plans import jobs


def test_raw_table_without_id_is_numbered(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("status,gene1,gene2\n1,0.5,2\n0,1.5,3\n1,2.5,4\n")
    raw = spark.read.csv(str(tmp_path / "raw.csv"), header=True)
    rows = sorted(tuple(r) for r in jobs.clean_raw_table(raw).select("Samples", "Group", "gene1").collect())
    assert rows == [("S1", 1, 0.5), ("S2", 0, 1.5), ("S3", 1, 2.5)]


def test_metric_lines_keep_the_panel_size(spark):
    rows = [("LDA", k, s, 0.1 * k, 0.5, 0.5) for k in (3, 5) for s in (2, 1)]
    metrics = spark.createDataFrame(rows, "model string, K int, split int, MCE double, Sensitivity double, Specificity double")
    assert [(r["K"], r["split"]) for r in figures.metric_lines(metrics).collect()] == [(3, 1), (3, 2), (5, 1), (5, 2)]
