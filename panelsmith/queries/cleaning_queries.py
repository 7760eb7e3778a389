"""Cleaning and reading, on documents, labels, events and embeddings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from panelsmith.operators import clean
from panelsmith.operators.metrics import unify_weights
from panelsmith.plans import jobs
from panelsmith.queries import sql_parts as parts
from panelsmith.queries.registry import query, rounded
from panelsmith.session import settle, shared_folder
from panelsmith.sources import readers, sinks
from panelsmith.sources.tables import embedding_genes, embedding_samples, long_matrix, table

# Label spellings cycled over the events.
SPELLINGS = (
    "CRC", "1-crc", "0-healthycontrol", "noncancer", "HC", "yes", "2", "1.0", "", "Tumour ", "NORMAL", " 0 ", "true", "maybe",
)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def spelled(events):
    """Each event with a label spelling; the last one stands for a missing label."""
    words = F.array(*[F.lit(w) for w in SPELLINGS], F.lit(None).cast("string"))
    return events.select("event_id", F.get(words, (F.col("event_id") % (len(SPELLINGS) + 1)).cast("int")).alias("word"))


SPELLED_SQL = f"spelled AS (SELECT event_id, ([{sql_list(SPELLINGS)}, NULL])[(event_id % {len(SPELLINGS) + 1}) + 1] AS word FROM events)"


def sql_norm(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '-', '_'),"
        f" '[():/]', ' ', 'g'), '[^a-z0-9_ ]+', '', 'g')"
    )


def sql_text_label(x: str) -> str:
    t = f"replace({sql_norm(x)}, ' ', '')"
    pos = " OR ".join(f"contains({t}, '{w}')" for w in clean.POSITIVE_PARTS)
    neg = " OR ".join(f"contains({t}, '{w}')" for w in clean.NEGATIVE_PARTS)
    return (
        f"CASE WHEN {t} IN ({sql_list(clean.POSITIVE_WORDS)}) THEN 1::DOUBLE WHEN {t} IN ({sql_list(clean.NEGATIVE_WORDS)}) THEN 0::DOUBLE"
        f" WHEN {pos} THEN 1::DOUBLE WHEN {neg} OR starts_with({t}, '0') THEN 0::DOUBLE END"
    )


@query(f"SELECT event_id, {sql_norm('raw')} AS header FROM (SELECT event_id, '  ' || upper(event_type) || '-Rate  (' || props || ')/X' AS raw FROM events)")
def header_normalise(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit("-Rate  ("), F.col("props"), F.lit(")/X"))
    return table(spark, sf_dir, "events").select("event_id", clean.normalised(raw).alias("header"))


@query(f"WITH {SPELLED_SQL} SELECT event_id, word, {sql_text_label('word')} AS label FROM spelled")
def label_text_to_binary(spark, sf_dir):
    return spelled(table(spark, sf_dir, "events")).withColumn("label", clean.text_label(F.col("word")))


@query(f"""WITH {SPELLED_SQL} SELECT event_id,
CASE WHEN lower(trim(word)) IN ({sql_list(clean.GROUP_POSITIVE)}) THEN 'Cancer'
     WHEN lower(trim(word)) IN ({sql_list(clean.GROUP_NEGATIVE)}) THEN 'Control' ELSE word END AS class FROM spelled""")
def label_map(spark, sf_dir):
    return spelled(table(spark, sf_dir, "events")).select("event_id", clean.group_label(F.col("word")).alias("class"))


@query(f"""WITH {SPELLED_SQL}, coded AS (SELECT event_id, word, {sql_text_label('word')} AS label FROM spelled)
SELECT coalesce(word, '(missing)') AS word, count(*) AS n FROM coded WHERE label IS NULL GROUP BY word""")
def label_violations(spark, sf_dir):
    coded = spelled(table(spark, sf_dir, "events")).withColumn("Group", clean.text_label(F.col("word")))
    return clean.label_violations(coded).groupBy(F.coalesce("word", F.lit("(missing)")).alias("word")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""WITH named AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 10 THEN event_type || '_CANCER_' || user_id ELSE event_type || user_id END AS name FROM events)
SELECT event_id, CASE WHEN coalesce(contains(lower(name), 'cancer'), false) THEN 'Cancer' ELSE 'Control' END AS class FROM named""")
def named_sample_labels(spark, sf_dir):
    name = (
        F.when(F.col("event_id") % 11 == 0, F.lit(None))
        .when(F.col("value") > 10, F.concat("event_type", F.lit("_CANCER_"), F.col("user_id").cast("string")))
        .otherwise(F.concat("event_type", F.col("user_id").cast("string")))
    )
    return table(spark, sf_dir, "events").select("event_id", clean.name_label(name).alias("class"))


@query(f"""SELECT doc_id, quality::DOUBLE AS q01, quality::DOUBLE AS q12, quality::DOUBLE AS q02,
{sql_text_label("(quality + toxic)::VARCHAR")} AS q012,
{sql_text_label("CASE WHEN toxic = 1 THEN '7' WHEN quality = 1 THEN 'Case' ELSE 'healthy' END")} AS words,
NULL::DOUBLE AS nothing FROM labels""")
def binary_coercion(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    raw = table(spark, sf_dir, "labels").select(
        "doc_id", q.cast("string").alias("q01"), (q + 1).cast("string").alias("q12"), (q * 2).cast("string").alias("q02"),
        (q + t).cast("string").alias("q012"),
        F.when(t == 1, "7").when(q == 1, "Case").otherwise("healthy").alias("words"),
        F.lit(None).cast("string").alias("nothing"),
    )
    names = [c for c in raw.columns if c != "doc_id"]
    coerced = clean.coerce_binary(raw, names)
    return raw.select("doc_id", *[coerced[n].alias(n) for n in names])


RAW_SQL = """
raw AS (
  SELECT 'doc' || doc_id AS "Sample ID", CASE WHEN quality = 1 THEN 2 ELSE 1 END AS code, n_chars::VARCHAR AS n_chars,
         text, regexp_extract(text, '[0-9]{1,9}') AS first_number, source || ' ' AS source,
         (len(text) - len(replace(text, ' ', '')))::VARCHAR || ' ' AS blanks, toxic::VARCHAR AS toxic
  FROM documents JOIN labels USING (doc_id))"""


def raw_table(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    return docs.join(labels, "doc_id").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("Sample ID"),
        (F.col("quality") + 1).cast("string").alias("Group (1/2)"),
        F.col("n_chars").cast("string").alias("n_chars"),
        "text",
        F.regexp_extract("text", "[0-9]{1,9}", 0).alias("first_number"),
        F.concat("source", F.lit(" ")).alias("source"),
        F.concat((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("string"), F.lit(" ")).alias("blanks"),
        F.col("toxic").cast("string").alias("toxic"),
    )


@query(f"""WITH {RAW_SQL} SELECT "Sample ID" AS "Samples", code - 1 AS "Group", n_chars::DOUBLE AS n_chars,
coalesce(try_cast(first_number AS DOUBLE), 0) AS first_number, blanks::DOUBLE AS blanks, toxic::DOUBLE AS toxic FROM raw""")
def labelled_table(spark, sf_dir):
    return jobs.clean_raw_table(raw_table(spark, sf_dir))


@query(f"""WITH {RAW_SQL} SELECT "Sample ID" AS sample, coalesce(try_cast(first_number AS DOUBLE), 0) AS first_number,
trim(blanks)::DOUBLE AS blanks FROM raw""")
def numeric_coerce_fill(spark, sf_dir):
    raw = raw_table(spark, sf_dir).select(F.col("Sample ID").alias("sample"), "first_number", "blanks")
    return clean.numeric_features(raw, ["first_number", "blanks"])


@query(f"""WITH {RAW_SQL},
cells AS (
  SELECT 'n_chars' AS feature, n_chars AS v FROM raw UNION ALL SELECT 'text', text FROM raw
  UNION ALL SELECT 'first_number', first_number FROM raw UNION ALL SELECT 'source', source FROM raw
  UNION ALL SELECT 'blanks', blanks FROM raw UNION ALL SELECT 'toxic', toxic FROM raw)
SELECT feature, count(try_cast(trim(v) AS DOUBLE)) AS numbers FROM cells GROUP BY feature HAVING count(try_cast(trim(v) AS DOUBLE)) > 0""")
def drop_all_null(spark, sf_dir):
    raw = raw_table(spark, sf_dir)
    names = ["n_chars", "text", "first_number", "source", "blanks", "toxic"]
    long = raw.unpivot([], names, "feature", "v")
    return long.groupBy("feature").agg(F.count(clean.number(F.col("v"))).alias("numbers")).where("numbers > 0")


@query(f"""WITH {RAW_SQL},
coded AS (
  SELECT 'Group (1/2)' AS label, code - 1 AS y FROM raw UNION ALL SELECT 'toxic', toxic::DOUBLE FROM raw
  UNION ALL SELECT 'n_chars', {sql_text_label("n_chars")} FROM raw
  UNION ALL SELECT 'first_number', {sql_text_label("first_number")} FROM raw
  UNION ALL SELECT 'blanks', {sql_text_label("blanks")} FROM raw)
SELECT label, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1) AS ones FROM coded GROUP BY label
HAVING count(*) FILTER (y = 0) > 0 AND count(*) FILTER (y = 1) > 0""")
def label_by_content(spark, sf_dir):
    raw = raw_table(spark, sf_dir)
    found = clean.binary_columns(raw, [c for c in raw.columns if c != "Sample ID"])
    coded = clean.coerce_binary(raw, found)
    return raw.select(*[coded[c].alias(c) for c in found]).unpivot([], found, "label", "y").groupBy("label").agg(
        F.count_if(F.col("y") == 0).alias("zeros"), F.count_if(F.col("y") == 1).alias("ones")
    )


ODD_NAMES_SQL = """
odd AS (SELECT event_id, ['X', 'XX', '', 'XIS'][(event_id % 4) + 1] || user_id || CASE WHEN event_id % 3 = 0 THEN '.0' ELSE '' END AS raw FROM events)"""


def odd_names(spark, sf_dir):
    heads = F.array(*[F.lit(h) for h in ("X", "XX", "", "XIS")])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.get(heads, (F.col("event_id") % 4).cast("int")), F.col("user_id").cast("string"),
            F.when(F.col("event_id") % 3 == 0, ".0").otherwise(""),
        ).alias("raw"),
    )


@query(f"WITH {ODD_NAMES_SQL} SELECT event_id, raw, regexp_replace(ltrim(raw, 'X'), '\\.0$', '') AS gene FROM odd")
def gene_id_normalise(spark, sf_dir):
    return odd_names(spark, sf_dir).withColumn("gene", clean.feature_id(F.col("raw")))


@query(f"""WITH {ODD_NAMES_SQL}, named AS (SELECT event_id AS gene_ix, regexp_replace(ltrim(raw, 'X'), '\\.0$', '') AS gene FROM odd)
SELECT gene_ix, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY gene_ix) AS seen FROM named) WHERE seen = 1""")
def dedupe_first(spark, sf_dir):
    names = odd_names(spark, sf_dir).select(F.col("event_id").alias("gene_ix"), clean.feature_id(F.col("raw")).alias("gene"))
    return clean.first_of_each(names)


@query("""SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS hms, (minute(ts) * 60 + second(ts))::DOUBLE AS ms, value AS plain FROM events""")
def duration_seconds(spark, sf_dir):
    h, mi, s = (f("ts").cast("string") for f in (F.hour, F.minute, F.second))
    two = lambda c: F.lpad(c, 2, "0")
    texts = table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(":", h, two(mi), two(s)).alias("hms"), F.concat_ws(":", mi, two(s)).alias("ms"),
        F.col("value").cast("string").alias("plain"),
    )
    return texts.select("event_id", *[clean.duration_seconds(F.col(c)).alias(c) for c in ("hms", "ms", "plain")])


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE ([1, 4, 16, 96])[(event_id % 5) + 1] END AS cores FROM events""")
def core_counts(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in ("1", "4", "16", "96", "NA")])
    return table(spark, sf_dir, "events").select(
        "event_id", clean.core_count(F.get(tags, (F.col("event_id") % 5).cast("int"))).alias("cores")
    )


# --- readers, on text tables that Spark writes from the given ones ---------------------------


def fresh(spark, name: str) -> str:
    return os.path.join(shared_folder(spark), "panelsmith", f"text-{uuid.uuid4().hex}", name)


def matrix_text(spark, sf_dir, path: str, labelled: bool) -> None:
    """The embeddings as a wide CSV table in sample order."""
    samples = embedding_samples(spark, sf_dir)
    width = samples.select(F.size("features")).first()[0]
    features = [F.get("features", F.lit(i)).alias(f"Xg{i}") for i in range(width)]
    front = [F.col("sample_id").alias("Samples"), (F.col("class") == "Cancer").cast("int").alias("Group")] if labelled else []
    ordered = samples.repartitionByRange("sample_ix").sortWithinPartitions("sample_ix")
    ordered.select(*front, *features).write.csv(path, header=True)


@query(f"WITH {parts.samples()} SELECT sample_ix + 1 AS sample_ix, 's' || sample_ix AS sample_id, class, 'g' || gene_ix AS gene, round(value, 6) AS value FROM long")
def grouped_adapter(spark, sf_dir):
    path = fresh(spark, "grouped")
    matrix_text(spark, sf_dir, path, labelled=True)
    samples, genes = readers.read_matrix(spark, path)
    cells = long_matrix(samples, genes).join(samples.select("sample_ix", "class"), "sample_ix")
    return rounded(cells.select("sample_ix", "sample_id", "class", "gene", "value"), "value")


@query(f"""WITH {parts.samples()}, n AS (SELECT count(*) AS n FROM samples)
SELECT 'sample_' || (sample_ix + 1) AS sample_id,
       CASE WHEN sample_ix + 1 <= n // 4 THEN 'ALL' WHEN sample_ix + 1 <= 2 * (n // 4) THEN 'AML'
            WHEN sample_ix + 1 <= 3 * (n // 4) THEN 'ALL' ELSE 'AML' END AS class,
       round(features[1], 6) AS first_value, len(features) AS width
FROM samples, n""")
def positional_labels(spark, sf_dir):
    path = fresh(spark, "positional")
    matrix_text(spark, sf_dir, path, labelled=False)
    n = embedding_samples(spark, sf_dir).count()
    quarter = n // 4
    runs = [(quarter, "ALL"), (quarter, "AML"), (quarter, "ALL"), (n - 3 * quarter, "AML")]
    samples, _ = readers.read_positional(spark, path, runs)
    return rounded(
        samples.select("sample_id", "class", F.get("features", F.lit(0)).alias("first_value"), F.size("features").cast("long").alias("width")),
        "first_value",
    )


@query("""SELECT "K", coalesce(model, '') AS model, count(*) AS n, round(sum(weight), 6) AS weight
FROM (SELECT ([3, 5, 10, 25, 50, 75, 100])[(event_id % 7) + 1] AS "K", event_type AS model, value AS weight FROM events) GROUP BY "K", model""")
def k_tagged_union(spark, sf_dir):
    folder = fresh(spark, "weights")
    events = table(spark, sf_dir, "events")
    ks = (3, 5, 10, 25, 50, 75, 100)
    for i, k in enumerate(ks):
        # the two stages name the model column differently
        name = "base" if i % 2 else "model"
        part = events.where(F.col("event_id") % 7 == i).select(
            F.col("user_id").alias("split"), F.col("event_type").alias(name), F.col("value").alias("weight")
        )
        sinks.write_tsv(part, f"{folder}/weights_k{k}.tsv")
    both = readers.read_k_family(spark, f"{folder}/weights_k*.tsv")
    one = unify_weights(both.withColumn("model", F.coalesce("model", "base")).drop("base"))
    return rounded(
        one.groupBy("K", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), "weight"
    )


@query("""SELECT cores, count(*) AS n, max(seconds) AS slowest FROM (
SELECT CASE WHEN event_id % 5 = 4 THEN NULL ELSE ([1, 4, 16, 96])[(event_id % 5) + 1] END AS cores, (minute(ts) * 60 + second(ts))::DOUBLE AS seconds FROM events) GROUP BY cores""")
def cores_tagged_union(spark, sf_dir):
    folder = fresh(spark, "stage1")
    events = table(spark, sf_dir, "events")
    for i, tag in enumerate(("1", "4", "16", "96", "NA")):
        part = events.where(F.col("event_id") % 5 == i).select(
            (F.minute("ts") * 60 + F.second("ts")).cast("double").alias("wall_clock_s")
        )
        sinks.write_tsv(part, f"{folder}/cores{tag}/wall_clock.tsv")
    merged = readers.read_cores_family(spark, f"{folder}/cores*/wall_clock.tsv")
    return merged.groupBy("cores").agg(F.count(F.lit(1)).alias("n"), F.max("wall_clock_s").alias("slowest"))


@query("""SELECT ([3, 5, 10, 25, 50, 75, 100])[("K" % 7) + 1] AS "K", rank, gene FROM (
  SELECT user_id % 7 AS "K", event_type || '_' || user_id AS gene,
         (row_number() OVER (PARTITION BY user_id % 7 ORDER BY count(*) DESC, event_type, user_id))::INTEGER AS rank
  FROM events GROUP BY user_id, event_type)""")
def panel_scan(spark, sf_dir):
    """Panels written as text, one gene per line, and read back in line order."""
    from pyspark.sql import Window

    ks = F.array(*[F.lit(k) for k in (3, 5, 10, 25, 50, 75, 100)])
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.col("user_id") % 7).orderBy(F.desc("n"), "event_type", "user_id")
    panels = counts.select(
        F.get(ks, (F.col("user_id") % 7).cast("int")).alias("K"),
        F.row_number().over(order).alias("rank"),
        F.concat(F.lit("  "), "event_type", F.lit("_"), F.col("user_id").cast("string")).alias("gene"),
    )
    path = fresh(spark, "panels")
    sinks.write_panels(panels, path)
    lines = readers.read_panel(spark, f"{path}/K=*")
    return lines.select(F.regexp_extract("file", r"/K=(\d+)/", 1).cast("int").alias("K"), "rank", "gene")


@query("""SELECT doc_id, source, n_chars FROM documents""")
def raw_copy(spark, sf_dir):
    """A text table passed through to Parquet."""
    raw, out = fresh(spark, "raw"), fresh(spark, "processed")
    table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").write.csv(raw, header=True)
    sinks.write_table(readers.read_csv(spark, raw), out)
    copied = spark.read.parquet(out)
    return copied.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_chars").cast("long").alias("n_chars"))


@query(f"""WITH {parts.selection(5)} SELECT split, "K", rank, gene FROM panels""")
def all_panels_sink(spark, sf_dir):
    """Every split's panel, stored by K and read back."""
    from panelsmith.queries.selection_queries import study

    path = fresh(spark, "all-panels")
    sinks.write_table(study(spark, sf_dir, 5).panels.select("split", "K", "rank", "gene"), path, "K")
    return spark.read.parquet(path)


@query("""SELECT 'S' || row_number() OVER (ORDER BY doc_id) AS sample_id, doc_id FROM documents""")
def generated_ids(spark, sf_dir):
    path = fresh(spark, "no-ids")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.csv(path, header=True)
    numbered = readers.with_row_number(readers.read_csv(spark, path))
    return numbered.select(F.concat(F.lit("S"), F.col("_row").cast("string")).alias("sample_id"), F.col("doc_id").cast("long").alias("doc_id"))
