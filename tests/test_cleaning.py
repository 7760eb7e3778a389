"""Hand-computed cleaning cases."""

import pytest
from pyspark.sql import functions as F

from panelsmith.operators import clean
from panelsmith.sources import readers, sinks


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_text_labels(spark):
    words = ["CRC", "1-crc", "0-healthycontrol", "noncancer", "HC", "yes", "2", "1.0", "", None]
    got = values(column(spark, words).withColumn("y", clean.text_label(F.col("v"))), "y")
    assert got == [1, 1, 0, 1, 0, 1, None, None, None, None]


@pytest.mark.parametrize("raw,expected", [
    (["0", "1", None], [0, 1, None]),
    (["1", "2", "2"], [0, 1, 1]),
    (["0", "2", "x"], [0, 1, None]),
    (["0", "1", "2"], [0, 1, None]),
    (["2", "2", "2"], [None, None, None]),
    ([None, None, None], [None, None, None]),
    (["7", "Case", "healthy"], [None, 1, 0]),
])
def test_binary_coercion(spark, raw, expected):
    df = column(spark, raw)
    assert values(df.withColumn("y", clean.coerce_binary(df, ["v"])["v"]), "y") == expected


def test_headers():
    assert clean.normalised_name(" Sample  ID ") == "sample id"
    assert clean.normalised_name("Group (0/1)") == "group  0 1 "
    assert clean.pick_header(["Bacteroides", "SAMPLE-ID", "Subject"], clean.ID_HEADERS, clean.ID_PARTS) == "Subject"
    assert clean.pick_header(["Bacteroides", "x"], clean.ID_HEADERS, clean.ID_PARTS) == "Bacteroides"
    assert clean.pick_header(["a", "b"], clean.ID_HEADERS, clean.ID_PARTS) is None
    assert clean.matrix_columns(["a", "GROUPS", "Sample_ID", "f"]) == ("GROUPS", "Sample_ID", ["a", "f"])
    assert clean.matrix_columns(["a", "label", "f"]) == ("label", "a", ["f"])


def test_header_values_agree_with_names(spark):
    raw = ["Sample ID", "SAMPLE-ID", "Group (0/1)", "a:b", "é!x"]
    got = values(column(spark, raw).withColumn("n", clean.normalised(F.col("v"))), "n")
    # values are trimmed like names, inside the text nothing is
    assert got == [clean.normalised_name(r) for r in raw]


def test_feature_ids(spark):
    raw = ["X123.0", "XX1", "XIST", "2", "10.0", "1.05"]
    got = values(column(spark, raw).withColumn("g", clean.feature_id(F.col("v"))), "g")
    assert got == ["123", "1", "IST", "2", "10", "1.05"] == [clean.feature_id_name(r) for r in raw]


def test_numeric_features(spark):
    df = spark.createDataFrame([(" 2 ", None, "a"), ("abc", None, "b"), (None, None, "3")], "p string, q string, r string")
    out = clean.numeric_features(df, ["p", "q", "r"])
    assert out.columns == ["p", "r"]
    assert sorted(tuple(r) for r in out.collect()) == [(0.0, 0.0), (0.0, 3.0), (2.0, 0.0)]


def test_labelled_table_and_errors(spark):
    raw = spark.createDataFrame([("a", "2", "1.5", "z"), ("b", "1", None, "z")], ["Sample ID", "Status", "f 1", "junk"])
    out = clean.labelled_table(raw)
    assert out.columns == ["Samples", "Group", "f 1"]
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 1.5), ("b", 0, 0.0)]
    with pytest.raises(ValueError, match="0/1"):
        clean.labelled_table(raw.withColumn("Status", F.lit("9")))
    with pytest.raises(ValueError, match="no label column"):
        clean.labelled_table(raw.drop("Status"))


def test_durations(spark):
    got = values(column(spark, ["12.5", "3:07", "1:02:03", None]).withColumn("s", clean.duration_seconds(F.col("v"))), "s")
    assert got == [12.5, 187.0, 3723.0, None]
    with pytest.raises(Exception, match="cannot read as a duration"):
        column(spark, ["1 day"]).select(clean.duration_seconds(F.col("v"))).collect()


def test_readers(spark, tmp_path):
    grouped = tmp_path / "grouped.csv"
    grouped.write_text("Samples,Group,X1.0,XX1,f\ns1,1,0.5,9,1\ns2,healthy,1.5,9,2\ns3,odd,2.5,9,3\n")
    samples, genes = readers.read_matrix(spark, str(grouped))
    rows = samples.orderBy("sample_ix").collect()
    assert [tuple(r) for r in rows] == [
        (1, "s1", "Cancer", [0.5, 1.0]), (2, "s2", "Control", [1.5, 2.0]), (3, "s3", "odd", [2.5, 3.0]),
    ]
    assert [r["gene"] for r in genes.orderBy("gene_ix").collect()] == ["1", "f"]

    named = tmp_path / "named.csv"
    named.write_text("id,normal_1,Cancer_2\nx,1.0,2.0\ny,3.0,4.0\n")
    samples, genes = readers.read_matrix(spark, str(named))
    assert [tuple(r)[1:] for r in samples.orderBy("sample_ix").collect()] == [
        ("normal_1", "Control", [1.0, 3.0]), ("Cancer_2", "Cancer", [2.0, 4.0]),
    ]
    assert [r["gene"] for r in genes.orderBy("gene_ix").collect()] == ["1", "2"]

    positional = tmp_path / "golub.csv"
    positional.write_text("g1,g2\n" + "\n".join(f"{i},{i}" for i in range(38)) + "\n")
    samples, _ = readers.read_matrix(spark, str(positional), "golub")
    labels = [r["class"] for r in samples.orderBy("sample_ix").collect()]
    assert labels == ["ALL"] * 27 + ["AML"] * 11
    positional.write_text("g1,g2\n1,2\n")
    with pytest.raises(ValueError, match="no labels known"):
        readers.read_positional(spark, str(positional))


def test_families(spark, tmp_path):
    (tmp_path / "w_k3.tsv").write_text("split\tbase\tweight\n1\trf\t0.5\n")
    (tmp_path / "w_k10.tsv").write_text("split\tmodel\tweight\n1\tsvm\t0.25\n")
    rows = readers.read_k_family(spark, f"{tmp_path}/w_k*.tsv").orderBy("K").collect()
    assert [(r["K"], r["base"], r["model"], r["weight"]) for r in rows] == [(3, "rf", None, 0.5), (10, None, "svm", 0.25)]
    with pytest.raises(FileNotFoundError):
        readers.read_k_family(spark, f"{tmp_path}/none_k*.tsv")
    assert readers.read_cores_family(spark, f"{tmp_path}/cores*/x.tsv", "cores int, wall_clock_s double").count() == 0
    assert readers.read_or_empty(spark, f"{tmp_path}/absent.tsv", "a int").count() == 0
    for tag, text in (("4", "0:00:09"), ("NA", "12.5")):
        (tmp_path / f"cores{tag}").mkdir()
        (tmp_path / f"cores{tag}" / "wall.tsv").write_text(f"s\th:m:s\n1\t{text}\n2\t9:00:00\n")
    tagged = readers.read_cores_family(spark, f"{tmp_path}/cores*/wall.tsv")
    assert {r["cores"] for r in tagged.collect()} == {4, None}
    seconds = readers.read_job_seconds(spark, f"{tmp_path}/cores*/wall.tsv")
    assert sorted(r["seconds"] for r in seconds.collect()) == [9.0, 12.5]


def test_panel_text(spark, tmp_path):
    panels = spark.createDataFrame([(3, 1, "b", 9), (3, 2, "a", 7), (5, 1, "z", 1)], "K int, rank int, gene string, count int")
    sinks.write_panels(panels, str(tmp_path / "panel"))
    sinks.write_panel_counts(panels, str(tmp_path / "counts"))
    (tmp_path / "loose.txt").write_text(" g2 \n\ng1\n")
    got = readers.read_panel(spark, f"{tmp_path}/panel/K=3").orderBy("rank").collect()
    assert [(r["rank"], r["gene"]) for r in got] == [(1, "b"), (2, "a")]
    got = readers.read_panel(spark, str(tmp_path / "loose.txt")).orderBy("rank").collect()
    assert [(r["rank"], r["gene"]) for r in got] == [(1, "g2"), (2, "g1")]
    sinks.write_tagged(panels, str(tmp_path / "tagged"), "run1")
    assert spark.read.parquet(str(tmp_path / "tagged")).select("run_tag").distinct().count() == 1
