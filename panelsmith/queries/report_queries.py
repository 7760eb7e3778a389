"""Weights, runtimes and figure tables, on events and lineitem and on the study's metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.design import K_LIST
from panelsmith.operators import figures, metrics as m, runtime, selection
from panelsmith.operators.clean import duration_seconds
from panelsmith.plans import jobs
from panelsmith.queries import sql_parts as parts
from panelsmith.queries.model_queries import BOTH_SQL, KNN_SPLITS, STABILITY_SQL, SUMMARY, both_models, stability_tables
from panelsmith.queries.registry import query, rounded
from panelsmith.queries.selection_queries import SPLITS, study
from panelsmith.session import settle
from panelsmith.sources.tables import table

K_SQL = "[" + ", ".join(map(str, K_LIST)) + "]"
BASES = ("click", "error", "purchase", "signup", "view")


def k_of(ix):
    return F.get(F.array(*[F.lit(k) for k in K_LIST]), (ix % len(K_LIST)).cast("int"))


# --- ensemble weights -----------------------------------------------------------------------

WEIGHTS_SQL = f"""
weights AS (
  SELECT ({K_SQL})[(event_id % 7) + 1] AS "K", user_id AS split, event_type AS model,
         avg(value) - (SELECT avg(value) FROM events) AS weight
  FROM events GROUP BY 1, 2, 3)"""


def weights(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    overall = events.select(F.avg("value")).scalar()
    means = events.groupBy(k_of(F.col("event_id")).alias("K"), F.col("user_id").alias("split"), F.col("event_type").alias("model")).agg(
        F.avg("value").alias("v")
    )
    return means.select("K", "split", "model", (F.col("v") - overall).alias("weight"))


def base_order():
    return F.array_position(F.array(*[F.lit(b) for b in BASES]), F.col("model"))


@query(f"""WITH {WEIGHTS_SQL} SELECT model, {', '.join(f'round(avg(weight) FILTER ("K" = {k}), 6) AS "{k}"' for k in K_LIST)} FROM weights GROUP BY model""")
def weights_pivot(spark, sf_dir):
    return rounded(m.weights_matrix(weights(spark, sf_dir), K_LIST), *map(str, K_LIST))


@query(f"""WITH {WEIGHTS_SQL}, wide AS (SELECT "K", split, {', '.join(f"max(weight) FILTER (model = '{b}') AS {b}" for b in BASES)} FROM weights GROUP BY ALL)
SELECT "K", split, model, round(weight, 6) AS weight FROM (UNPIVOT wide ON {', '.join(BASES)} INTO NAME model VALUE weight)""")
def weights_wide_to_long(spark, sf_dir):
    wide = weights(spark, sf_dir).groupBy("K", "split").pivot("model", list(BASES)).agg(F.max("weight"))
    return rounded(m.unify_weights(wide).where("weight is not null"), "weight")


@query(f"""WITH {WEIGHTS_SQL} SELECT "K", model, round(avg(weight), 6) AS weight FROM weights GROUP BY "K", model""")
def weights_mean(spark, sf_dir):
    return rounded(m.mean_weights(weights(spark, sf_dir)), "weight")


@query(f"""WITH {WEIGHTS_SQL} SELECT "K", model, count(*) AS count FROM weights WHERE weight > 0 GROUP BY "K", model""")
def weights_positive(spark, sf_dir):
    return m.positive_counts(weights(spark, sf_dir))


HIGHEST_SQL = f"""{WEIGHTS_SQL}, highest AS (
  SELECT "K", model, count(*) AS count FROM (
    SELECT *, row_number() OVER (PARTITION BY "K", split ORDER BY weight DESC, model) AS place FROM weights) WHERE place = 1
  GROUP BY "K", model)"""


@query(f'WITH {HIGHEST_SQL} SELECT "K", model, count FROM highest')
def weights_highest(spark, sf_dir):
    return m.highest_counts(weights(spark, sf_dir), base_order())


@query(f"""WITH {HIGHEST_SQL} SELECT g.model, g."K", coalesce(h.count, 0) AS count
FROM (SELECT DISTINCT a.model, b."K" FROM highest a, highest b) g LEFT JOIN highest h ON g.model = h.model AND g."K" = h."K" """)
def zero_filled_counts(spark, sf_dir):
    return m.zero_filled(m.highest_counts(weights(spark, sf_dir), base_order()))


# --- runtimes -------------------------------------------------------------------------------

RUNS_SQL = f"""
runs AS (
  SELECT l_returnflag || l_linestatus AS model, ({K_SQL})[(l_orderkey % 7) + 1] AS "K", ([1, 4, 16, 32])[(l_linenumber % 4) + 1] AS cores,
         l_quantity / 100 AS train_s, l_discount AS pred_s, (l_orderkey * 10 + l_linenumber)::BIGINT AS split
  FROM lineitem),
per_core AS (
  SELECT model, "K", cores, avg(train_s) AS "Train_mean", avg(pred_s) AS "Pred_mean", sum(train_s) AS "Train_total", sum(pred_s) AS "Pred_total"
  FROM runs GROUP BY ALL)"""
FOUR = ["Train_mean", "Pred_mean", "Train_total", "Pred_total"]
FOUR_SQL = ", ".join(f'round("{c}", 6) AS "{c}"' for c in FOUR)


def runs(spark, sf_dir):
    cores = F.array(*[F.lit(c) for c in (1, 4, 16, 32)])
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"), k_of(F.col("l_orderkey")).alias("K"),
        F.get(cores, F.col("l_linenumber") % 4).alias("cores"),
        (F.col("l_quantity") / 100).alias("train_s"), F.col("l_discount").alias("pred_s"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("split"),
    )


@query(f'WITH {RUNS_SQL} SELECT model, "K", cores, {FOUR_SQL} FROM per_core')
def runtime_per_core(spark, sf_dir):
    return rounded(runtime.per_core(runs(spark, sf_dir)), *FOUR)


@query(f'WITH {RUNS_SQL} SELECT model, "K", cores, {FOUR_SQL} FROM per_core ORDER BY model, cores, "K"')
def runtime_merge(spark, sf_dir):
    return rounded(runtime.merged(runtime.per_core(runs(spark, sf_dir))), *FOUR)


@query(f'WITH {RUNS_SQL} SELECT model, "K", {FOUR_SQL}, round("Train_total" + "Pred_total", 6) AS "Runtime_total" FROM per_core WHERE cores = (SELECT max(cores) FROM per_core)')
def runtime_sum(spark, sf_dir):
    picked = runtime.representative(runtime.per_core(runs(spark, sf_dir)))
    return rounded(runtime.with_runtime_total(picked), *FOUR, "Runtime_total")


@query(f'WITH {RUNS_SQL} SELECT model, cores, round(sum("Train_total"), 6) AS "Train_total", round(sum("Pred_total"), 6) AS "Pred_total" FROM per_core GROUP BY model, cores')
def runtime_totals(spark, sf_dir):
    return rounded(runtime.totals(runtime.per_core(runs(spark, sf_dir))), "Train_total", "Pred_total")


@query(f'WITH {RUNS_SQL} SELECT cores, model, round(avg("Train_mean"), 6) AS mean, round(stddev_samp("Train_mean"), 6) AS sd FROM per_core GROUP BY cores, model')
def metric_by_cores(spark, sf_dir):
    return rounded(runtime.metric_by_cores(runtime.per_core(runs(spark, sf_dir)), "Train_mean"), "mean", "sd")


CLOCK_SQL = """
clock AS (
  SELECT ([1, 4, 16, 32])[(event_id % 4) + 1] AS cores,
         max((hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE / ([1, 4, 16, 32])[(event_id % 4) + 1]) AS wall_clock_s
  FROM events GROUP BY 1)"""


def clock(spark, sf_dir):
    cores = F.get(F.array(*[F.lit(c) for c in (1, 4, 16, 32)]), (F.col("event_id") % 4).cast("int"))
    text = F.concat_ws(":", F.hour("ts").cast("string"), F.minute("ts").cast("string"), F.second("ts").cast("string"))
    jobs = table(spark, sf_dir, "events").select(cores.alias("cores"), (duration_seconds(text) / cores).alias("seconds"))
    return runtime.wall_clock(jobs)


@query(f"WITH {CLOCK_SQL} SELECT cores, round(wall_clock_s, 6) AS wall_clock_s FROM clock")
def wall_clock_max(spark, sf_dir):
    return rounded(clock(spark, sf_dir), "wall_clock_s")


@query(f"""WITH {CLOCK_SQL} SELECT cores, round(wall_clock_s, 6) AS wall_clock_s,
round((SELECT wall_clock_s FROM clock ORDER BY cores LIMIT 1) / wall_clock_s, 6) AS speed_up FROM clock""")
def speed_up(spark, sf_dir):
    return rounded(runtime.speed_up(clock(spark, sf_dir)), "wall_clock_s", "speed_up")


# --- figure tables --------------------------------------------------------------------------


@query(f"""WITH {parts.selection(SPLITS)}, freq AS (SELECT "K", gene, count(*) AS count FROM panels GROUP BY ALL)
SELECT * FROM (SELECT "K", gene, count, (row_number() OVER (PARTITION BY "K" ORDER BY count DESC, gene))::INTEGER AS place FROM freq) WHERE place <= 30""")
def top30_freq(spark, sf_dir):
    return figures.top_genes(selection.selection_frequency(study(spark, sf_dir).panels))


MELT_SQL = """
melted AS (
  SELECT model, "K", split, 'MCE' AS "Metric", "MCE" AS "Score" FROM metrics
  UNION ALL SELECT model, "K", split, 'Sensitivity', "Sensitivity" FROM metrics
  UNION ALL SELECT model, "K", split, 'Specificity', "Specificity" FROM metrics)"""


def study_metrics(spark, sf_dir):
    s, p = both_models(spark, sf_dir)
    return s.split_metrics(p)


@query(f'WITH {BOTH_SQL} SELECT model, "K", split, round("MCE", 6) AS "MCE", round("Sensitivity", 6) AS "Sensitivity", round("Specificity", 6) AS "Specificity" FROM metrics')
def metric_lines(spark, sf_dir):
    return rounded(figures.metric_lines(study_metrics(spark, sf_dir)), "MCE", "Sensitivity", "Specificity")


@query(f'WITH {BOTH_SQL}, {MELT_SQL} SELECT model, "K", split, "Metric", round("Score", 6) AS "Score" FROM melted')
def metric_melt(spark, sf_dir):
    return rounded(figures.melted(study_metrics(spark, sf_dir), ["model", "K", "split"]), "Score")


def box_sql(source: str, keys: str, value: str) -> str:
    return f"""
quarts AS (SELECT {keys}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
  FROM {source} GROUP BY {keys})
SELECT {keys}, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       round(min({value}) FILTER (ok), 6) AS lo_whisker, round(max({value}) FILTER (ok), 6) AS hi_whisker, count(*) FILTER (NOT ok) AS outliers
FROM (SELECT *, {value} BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM {source} JOIN quarts USING ({keys}))
GROUP BY {keys}"""


BOX = ["q1", "median", "q3", "lo_whisker", "hi_whisker"]


@query(f"""WITH {BOTH_SQL}, {MELT_SQL}, {box_sql('melted', 'model, "K", "Metric"', '"Score"')}""")
def box_stats(spark, sf_dir):
    long = settle(figures.melted(study_metrics(spark, sf_dir), ["model", "K", "split"]), "melted")
    return rounded(figures.box_stats(long.dropna(subset=["Score"]), ["model", "K", "Metric"], "Score"), *BOX)


@query(f"""WITH {RUNS_SQL}, {box_sql('runs', 'model, "K"', 'train_s')}""")
def box_stats_runtime(spark, sf_dir):
    return rounded(figures.box_stats(runs(spark, sf_dir), ["model", "K"], "train_s"), *BOX)


@query(f"""WITH {BOTH_SQL}, summary AS (SELECT model, "K", avg("MCE") AS m, stddev_samp("MCE") / sqrt(count(*)) AS se FROM metrics GROUP BY model, "K")
SELECT model, "K", round(m, 6) AS mean, round(m - se, 6) AS lower, round(m + se, 6) AS upper FROM summary""")
def se_band(spark, sf_dir):
    return rounded(figures.se_band(m.summary(study_metrics(spark, sf_dir)), "MCE"), "mean", "lower", "upper")


@query(f"""WITH {BOTH_SQL}, summary AS (SELECT model, "K", avg("MCE") AS a, avg("Sensitivity") AS b, avg("Specificity") AS c FROM metrics GROUP BY model, "K")
SELECT model, "K", 'MCE' AS "Metric", round(a, 6) AS "Score" FROM summary
UNION ALL SELECT model, "K", 'Sensitivity', round(b, 6) FROM summary UNION ALL SELECT model, "K", 'Specificity', round(c, 6) FROM summary""")
def metric_bars(spark, sf_dir):
    named = m.canonical_names(m.summary(study_metrics(spark, sf_dir)))
    return rounded(figures.melted(named, ["model", "K"]), "Score")


@query(f"""WITH {STABILITY_SQL}, by_k AS (SELECT "K", source, avg(j) AS mean, stddev_pop(j) AS sd FROM scores GROUP BY "K", source)
SELECT "K", source AS series, round(mean, 6) AS mean, round(mean - sd, 6) AS lower, round(mean + sd, 6) AS upper FROM by_k""")
def stability_band(spark, sf_dir):
    by_k = m.stability_by_k(stability_tables(spark, sf_dir))
    return rounded(figures.stability_band(by_k), "mean", "lower", "upper")


@query(f"""WITH {parts.selection(SPLITS)},
lists AS (SELECT "K", split AS id, list(gene) AS genes FROM panels GROUP BY ALL),
pairs AS (SELECT a."K", len(list_intersect(a.genes, b.genes))::DOUBLE / len(list_distinct(list_concat(a.genes, b.genes))) AS jaccard
  FROM lists a JOIN lists b ON a."K" = b."K" AND a.id < b.id), {box_sql('pairs', '"K"', 'jaccard')}""")
def jaccard_box(spark, sf_dir):
    pairs = settle(m.pair_similarity(settle(m.panel_lists(study(spark, sf_dir).panels, "split"), "lists")), "pairs")
    return rounded(figures.box_stats(pairs, ["K"], "jaccard"), *BOX)


@query(f"""WITH {RUNS_SQL} SELECT count(DISTINCT model) AS models, count(DISTINCT "K") AS ks, count(DISTINCT cores) AS core_counts FROM runs""")
def distinct_listing(spark, sf_dir):
    return runs(spark, sf_dir).agg(
        F.countDistinct("model").alias("models"), F.countDistinct("K").alias("ks"), F.countDistinct("cores").alias("core_counts")
    )


@query()
def stage1_job(spark, sf_dir):
    """Timed metrics of the closed-form models for every split and K."""
    table, _ = jobs.evaluate(study(spark, sf_dir, 5, rule="planted"), 1, ("LDA", "DLDA", "kNN"))
    return table
