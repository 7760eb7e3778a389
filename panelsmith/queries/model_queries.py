"""Classifiers and error measures on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.operators import metrics as m, selection, smote as smote_rows
from panelsmith.operators.models.stack import BASES
from panelsmith.queries import sql_parts as parts
from panelsmith.queries.registry import query, rounded
from panelsmith.queries.selection_queries import FROZEN_SQL, SPLITS, study
from panelsmith.session import settle

KNN_SPLITS = 5
SUMMARY = ["MCE_mean", "MCE_se", "Sens_mean", "Sens_se", "Spec_mean", "Spec_se"]
STAGE2_SQL = f"""{FROZEN_SQL},
fixed AS (
  SELECT s.rep, s.split, f."K", f.rank, substr(f.gene, 2)::INTEGER AS gene_ix, f.gene
  FROM frozen f JOIN (SELECT DISTINCT rep, split FROM splits) s USING (rep))"""


def predictions(s, df):
    return rounded(
        df.select("model", s.design.rep_of(F.col("slot")).alias("rep"), s.design.split_of(F.col("slot")).alias("split"),
                  "K", "sample_ix", "class", "p_pos", "predicted"),
        "p_pos",
    )


PREDICTION_SQL = 'SELECT model, rep, split, "K", sample_ix, class, round(p_pos, 6) AS p_pos, predicted FROM'
METRIC_SQL = 'SELECT model, rep, split, "K", round("MCE", 6) AS "MCE", round("Sensitivity", 6) AS "Sensitivity", round("Specificity", 6) AS "Specificity" FROM'


@query(f"""WITH {parts.selection(3)}
SELECT split, "K", sample_ix, class = 'Cancer' AS is_pos, role = 'train' AS in_train,
       round(list_sum(list(value * rank ORDER BY rank)), 6) AS weighted, count(*) AS width
FROM panels JOIN long USING (gene_ix) JOIN splits USING (rep, split, sample_ix, class) GROUP BY ALL""")
def train_test_cells(spark, sf_dir):
    s = study(spark, sf_dir, 3)
    dot = F.aggregate(
        F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    rows = s.cells(1).rows.select(
        s.design.split_of(F.col("slot")).alias("split"), "K", "sample_ix", "is_pos", "in_train",
        dot.alias("weighted"), F.size("x").cast("long").alias("width"),
    )
    return rounded(rows, "weighted")


@query(f"WITH {parts.selection(SPLITS)}, {parts.POPULATION}, {parts.naive_bayes()} {PREDICTION_SQL} nb_pred")
def gaussian_nb(spark, sf_dir):
    s = study(spark, sf_dir)
    return predictions(s, s.cells(1).naive_bayes())


@query(f"WITH {parts.selection(SPLITS, 'imbalanced')}, {parts.POPULATION}, {parts.naive_bayes(balanced=True)} {PREDICTION_SQL} nb_pred")
def gaussian_nb_weighted(spark, sf_dir):
    s = study(spark, sf_dir, rule="imbalanced")
    return predictions(s, s.cells(1).naive_bayes())


@query(f"WITH {parts.selection(KNN_SPLITS)}, {parts.POPULATION}, {parts.neighbours()} {PREDICTION_SQL} knn_pred")
def knn_vote(spark, sf_dir):
    s = study(spark, sf_dir, KNN_SPLITS)
    return predictions(s, s.cells(1).neighbours())


@query(f"""WITH {parts.selection(SPLITS)}, {STAGE2_SQL} SELECT split, "K", rank, gene_ix, gene FROM fixed""")
def stage2_panel_restrict(spark, sf_dir):
    s = study(spark, sf_dir)
    return s.stage2_panels.select(s.design.split_of(F.col("slot")).alias("split"), "K", "rank", "gene_ix", "gene")


def smote_sql(n_splits: int) -> str:
    """Synthetic minority rows by split and panel: base row, near row and the place between them."""
    return f"""{parts.selection(n_splits, 'imbalanced')},
vec AS (
  SELECT split, "K", sample_ix, class, role, list(value ORDER BY rank) AS v
  FROM panels JOIN long USING (gene_ix) JOIN splits USING (rep, split, sample_ix, class) GROUP BY ALL),
minor AS (SELECT *, row_number() OVER (PARTITION BY split, "K" ORDER BY sample_ix) AS base_no FROM vec WHERE role = 'train' AND class = 'Cancer'),
sizes AS (SELECT split, "K", count(*) FILTER (class = 'Cancer') AS n_min, count(*) FILTER (class <> 'Cancer') - count(*) FILTER (class = 'Cancer') AS need
  FROM vec WHERE role = 'train' GROUP BY ALL),
near AS (
  SELECT a.split, a."K", a.sample_ix AS base_ix, b.sample_ix AS near_ix, b.v AS near_v,
         row_number() OVER (PARTITION BY a.split, a."K", a.sample_ix ORDER BY list_distance(a.v, b.v), b.sample_ix) AS nth
  FROM minor a JOIN minor b ON a.split = b.split AND a."K" = b."K" AND a.sample_ix <> b.sample_ix),
keys AS (
  SELECT split, "K", n_min, least(5, n_min - 1) AS n_near, unnest(range(1, need + 1)) AS j FROM sizes WHERE n_min >= 2),
draws AS (
  SELECT *, md5('smote|1|0|' || split || '|0|' || "K" || '|' || j) AS h FROM keys),
picked AS (
  SELECT split, "K", j, ('0x' || substr(h, 1, 10))::BIGINT % n_min + 1 AS base_no, ('0x' || substr(h, 11, 10))::BIGINT % n_near + 1 AS nth,
         ('0x' || substr(h, 21, 10))::BIGINT::DOUBLE / 1099511627776 AS u FROM draws)"""


SMOTE_SQL = f"""{smote_sql(3)}
SELECT split, "K", j, base_ix, near_ix, round(u, 6) AS u,
       round(list_sum([(i) * (a + u * (b - a)) for a, b, i in list_zip(v, near_v, range(1, len(v) + 1))]), 6) AS weighted
FROM picked JOIN (SELECT split, "K", base_no, sample_ix AS base_ix, v FROM minor) USING (split, "K", base_no) JOIN near USING (split, "K", base_ix, nth)"""
SMOTE_SQL = SMOTE_SQL.replace("[(i) * (a + u * (b - a)) for a, b, i in list_zip(v, near_v, range(1, len(v) + 1))]",
                              "list_transform(list_zip(v, near_v, range(1, len(v) + 1)), lambda z: z[3] * (z[1] + u * (z[2] - z[1])))")


def oversampled_sql(n_splits: int) -> str:
    """Training vectors with the synthetic rows among them: over(split, K, sample_ix, class, v), and flat with a row per value."""
    return f"""{smote_sql(n_splits)},
over AS (
  SELECT split, "K", sample_ix, class, v FROM vec WHERE role = 'train'
  UNION ALL
  SELECT split, "K", -j, 'Cancer', list_transform(list_zip(v, near_v), lambda z: z[1] + u * (z[2] - z[1]))
  FROM picked JOIN (SELECT split, "K", base_no, sample_ix AS base_ix, v FROM minor) USING (split, "K", base_no)
       JOIN near USING (split, "K", base_ix, nth)),
flat AS (SELECT split, "K", sample_ix, class, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM over)"""


KNN_OVER_SQL = f"""WITH {oversampled_sql(KNN_SPLITS)},
devs AS (
  SELECT split, "K", list(CASE WHEN dev = 0 THEN 1 ELSE dev END ORDER BY place) AS devs
  FROM (SELECT split, "K", place, stddev_pop(x) AS dev FROM flat GROUP BY ALL) GROUP BY ALL),
learn AS (SELECT o.*, list_transform(list_zip(v, devs), lambda z: z[1] / z[2]) AS s FROM over o JOIN devs USING (split, "K")),
ask AS (SELECT t.*, list_transform(list_zip(v, devs), lambda z: z[1] / z[2]) AS s FROM vec t JOIN devs USING (split, "K") WHERE role = 'test'),
met AS (
  SELECT q.split, q."K", q.sample_ix, q.class, t.class AS near_class, list_distance(q.s, t.s) AS d,
         row_number() OVER (PARTITION BY q.split, q."K", q.sample_ix ORDER BY list_distance(q.s, t.s), t.sample_ix) AS nth
  FROM ask q JOIN learn t ON q.split = t.split AND q."K" = t."K"),
voted AS (
  SELECT split, "K", sample_ix, class,
         CASE WHEN min(d) = 0 THEN sum(CASE WHEN d = 0 AND near_class = 'Cancer' THEN 1.0::DOUBLE ELSE 0 END) / sum(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END)
              ELSE sum(CASE WHEN near_class = 'Cancer' THEN 1 / d ELSE 0 END) / sum(1 / d) END AS p_pos
  FROM met WHERE nth <= 3 GROUP BY ALL),
both_pred AS (SELECT 'kNN' AS model, 0 AS rep, *, CASE WHEN p_pos >= 0.5 THEN 'Cancer' ELSE 'Control' END AS predicted FROM voted)
{PREDICTION_SQL} both_pred"""


LDA_OVER_SQL = f"""WITH RECURSIVE {oversampled_sql(5)},
class_means AS (SELECT split, "K", place, class, avg(x) AS mean, count(*) AS n FROM flat GROUP BY ALL),
centred AS (SELECT split, "K", sample_ix, place, x - mean AS c FROM flat JOIN class_means USING (split, "K", place, class)),
scatter AS (
  SELECT a.split, a."K", a.place, b.place AS other, sum(a.c * b.c) AS s
  FROM centred a JOIN centred b USING (split, "K", sample_ix) GROUP BY ALL),
sides AS (
  SELECT split, "K", place, max(mean) FILTER (class = 'Cancer') AS m1, max(mean) FILTER (class <> 'Cancer') AS m0,
         max(n) FILTER (class = 'Cancer') AS n1, max(n) FILTER (class <> 'Cancer') AS n0 FROM class_means GROUP BY ALL),
lda_pred_system AS (
  SELECT 0 AS rep, split, "K", count(*) AS width, any_value(n1) AS n1, any_value(n0) AS n0, list((m1 + m0) / 2 ORDER BY place) AS middle,
         list(list_append(list_transform(line, lambda v: v / (n1 + n0 - 2)), m1 - m0) ORDER BY place) AS m
  FROM (SELECT split, "K", place, list(s ORDER BY other) AS line FROM scatter GROUP BY ALL) JOIN sides USING (split, "K", place) GROUP BY split, "K"),
lda_pred_test AS (SELECT 0 AS rep, split, "K", sample_ix, class, v FROM vec WHERE role = 'test'),
{parts.eliminated('lda_pred')} {PREDICTION_SQL} lda_pred"""


@query(f"WITH {SMOTE_SQL}")
def smote(spark, sf_dir):
    s = study(spark, sf_dir, 3, rule="imbalanced")
    extra = smote_rows.synthetic(settle(s.cells(1).train, "train"), s.design)
    dot = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    out = extra.select(s.design.split_of(F.col("slot")).alias("split"), "K", "j", "base_ix", "near_ix", "u", dot.alias("weighted"))
    return rounded(out, "u", "weighted")


@query(f"WITH RECURSIVE {parts.selection(SPLITS, 'planted')}, {parts.discriminant()} {PREDICTION_SQL} lda_pred")
def lda(spark, sf_dir):
    s = study(spark, sf_dir, rule="planted")
    return predictions(s, s.cells(1).lda())


@query(LDA_OVER_SQL)
def lda_oversampled(spark, sf_dir):
    s = study(spark, sf_dir, 5, rule="imbalanced")
    return predictions(s, s.cells(1).lda())


@query(KNN_OVER_SQL)
def knn_oversampled(spark, sf_dir):
    s = study(spark, sf_dir, KNN_SPLITS, rule="imbalanced")
    return predictions(s, s.cells(1).neighbours())


@query()
def svm_calibrated(spark, sf_dir):
    s = study(spark, sf_dir, 3, rule="planted")
    return predictions(s, s.cells(1).svm())


@query()
def svm_calibrated_weighted(spark, sf_dir):
    s = study(spark, sf_dir, 2, rule="imbalanced")
    return predictions(s, s.cells(1).svm())


@query()
def lasso_cv(spark, sf_dir):
    s = study(spark, sf_dir, 3, rule="planted")
    return predictions(s, s.lasso_all_features())


@query()
def lasso_cv_oversampled(spark, sf_dir):
    s = study(spark, sf_dir, 2, rule="imbalanced")
    return predictions(s, s.lasso_all_features())


@query()
def random_forest(spark, sf_dir):
    s = study(spark, sf_dir, rule="planted")
    return predictions(s, s.cells(1).forest())


@query()
def super_learner(spark, sf_dir):
    s = study(spark, sf_dir, 1, rule="planted", k_list=(10,))
    scored, weights = s.super_learner()
    by_base = weights.groupBy("slot", "K").agg(F.map_from_entries(F.collect_list(F.struct("base", "weight"))).alias("weights"))
    return predictions(s, scored).join(
        by_base.select(F.col("K"), *[F.round(F.element_at("weights", b), 6).alias(f"SL_w_{b}") for b, _ in BASES]), "K"
    )


BOTH_SQL = f"""{parts.selection(KNN_SPLITS, 'planted')}, {parts.POPULATION}, {parts.naive_bayes()}, {parts.neighbours()},
both_pred AS (SELECT * FROM nb_pred UNION ALL SELECT * FROM knn_pred), {parts.metrics('both_pred')}"""


def both_models(spark, sf_dir):
    s = study(spark, sf_dir, KNN_SPLITS, rule="planted")
    return s, s.cells(1).naive_bayes().unionByName(s.cells(1).neighbours())


@query(f'WITH {BOTH_SQL} SELECT model, rep, split, "K", tp, tn, fp, fn, rows FROM metrics_counts')
def confusion(spark, sf_dir):
    s, p = both_models(spark, sf_dir)
    counts = m.confusion(p, ["model", "slot", "K"], s.design.pos, s.design.neg)
    return counts.select("model", s.design.rep_of(F.col("slot")).alias("rep"), s.design.split_of(F.col("slot")).alias("split"),
                         "K", "tp", "tn", "fp", "fn", "rows")


@query(f"WITH {BOTH_SQL} {METRIC_SQL} metrics")
def split_metrics(spark, sf_dir):
    s, p = both_models(spark, sf_dir)
    return rounded(s.split_metrics(p), "MCE", "Sensitivity", "Specificity")


@query(f'WITH {BOTH_SQL} SELECT model, "K", {parts.SUMMARY_COLUMNS} FROM metrics GROUP BY model, "K"')
def summary_stage1(spark, sf_dir):
    s, p = both_models(spark, sf_dir)
    return rounded(m.summary(s.split_metrics(p)), *SUMMARY)


@query(f"""WITH {parts.selection(KNN_SPLITS)}, {STAGE2_SQL}, {parts.POPULATION},
{parts.naive_bayes('fixed')}, {parts.neighbours('fixed')},
both_pred AS (SELECT * FROM nb_pred UNION ALL SELECT * FROM knn_pred), {parts.metrics('both_pred')}
SELECT model, "K", {parts.SUMMARY_COLUMNS} FROM metrics GROUP BY model, "K" """)
def summary_stage2(spark, sf_dir):
    s = study(spark, sf_dir, KNN_SPLITS)
    p = s.cells(2).naive_bayes().unionByName(s.cells(2).neighbours())
    return rounded(m.summary(s.split_metrics(p)), *SUMMARY)


# --- stability ------------------------------------------------------------------------------

PAIRS_SQL = """
lists AS (SELECT "K", split AS id, list(gene ORDER BY rank) AS genes FROM panels GROUP BY ALL),
rep_lists AS (SELECT "K", rep AS id, list(gene ORDER BY rank) AS genes FROM frozen GROUP BY ALL),
pairs AS (
  SELECT a."K", a.id AS a, b.id AS b, a.genes AS ga, b.genes AS gb FROM lists a JOIN lists b ON a."K" = b."K" AND a.id < b.id),
rep_pairs AS (
  SELECT a."K", a.id AS a, b.id AS b, a.genes AS ga, b.genes AS gb FROM rep_lists a JOIN rep_lists b ON a."K" = b."K" AND a.id < b.id)"""
JACCARD = "len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb)))"


@query(f"""WITH {parts.selection(SPLITS)}, {FROZEN_SQL}, {PAIRS_SQL}
SELECT "K", a, b, len(ga) AS size_a, len(gb) AS size_b FROM pairs""")
def panel_pairs(spark, sf_dir):
    s = study(spark, sf_dir)
    lists = settle(m.panel_lists(s.panels, "split"), "lists")
    return m.panel_pairs(lists).select(
        "K", "a", "b", F.size("genes_a").cast("long").alias("size_a"), F.size("genes_b").cast("long").alias("size_b")
    )


@query(f"""WITH {parts.selection(SPLITS)}, {FROZEN_SQL}, {PAIRS_SQL}
SELECT "K", a, b, round({JACCARD}, 6) AS jaccard FROM pairs""")
def jaccard_pairs(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(m.pair_similarity(settle(m.panel_lists(s.panels, "split"), "lists")), "jaccard")


def rank_order(column: str, pair: str) -> str:
    return f"row_number() OVER (PARTITION BY {pair} ORDER BY {column})::DOUBLE"


SPEARMAN_SQL = f"""
shared AS (
  SELECT x."K", x.split AS a, y.split AS b, x.rank AS rank_a, y.rank AS rank_b
  FROM panels x JOIN panels y ON x."K" = y."K" AND x.gene = y.gene AND x.split < y.split),
again AS (SELECT "K", a, b, {rank_order('rank_a', '"K", a, b')} AS ra, {rank_order('rank_b', '"K", a, b')} AS rb FROM shared)
SELECT "K", a, b, count(*) AS common, CASE WHEN abs(corr(ra, rb)) < 1e-12 THEN 0 ELSE round(corr(ra, rb), 6) END AS spearman FROM again GROUP BY "K", a, b HAVING count(*) >= 2"""


@query(f"WITH {parts.selection(SPLITS)}, {SPEARMAN_SQL}")
def spearman_pairs(spark, sf_dir):
    return rounded(m.spearman_pairs(study(spark, sf_dir).panels, "split"), "spearman")


@query(f"""WITH {parts.selection(SPLITS)}, {SPEARMAN_SQL.replace('SELECT "K", a, b, count(*) AS common', ', correlated AS (SELECT "K", a, b, count(*) AS common')})
SELECT "K", count(*) AS pairs, round(avg(spearman), 5) AS "Spearman_Mean", round(stddev_pop(spearman), 5) AS "Spearman_Std" FROM correlated GROUP BY "K" """)
def spearman_by_k(spark, sf_dir):
    pairs = rounded(m.spearman_pairs(study(spark, sf_dir).panels, "split"), "spearman")
    return rounded(m.spearman_by_k(pairs), "Spearman_Mean", "Spearman_Std", places=5)


def stability_tables(spark, sf_dir):
    """Replicate 0 gives the original split panels, replicates 1… the aggregated ones."""
    s = study(spark, sf_dir, 5, first_rep=0, n_reps=5)
    panels = settle(s.panels, "panels")
    freq = selection.selection_frequency(panels.where("rep > 0"), "rep")
    original = settle(m.panel_lists(panels.where("rep = 0"), "split"), "lists")
    aggregated = settle(m.panel_lists(selection.frozen_panels(freq, "rep"), "rep"), "rep-lists")
    return m.stability(original, aggregated)


STABILITY_SQL = f"""{parts.selection(5, 'balanced', (3, 5, 10, 25, 50, 75, 100), 0, 5)}, {FROZEN_SQL},
lists AS (SELECT "K", split AS id, list(gene ORDER BY rank) AS genes FROM panels WHERE rep = 0 GROUP BY ALL),
rep_lists AS (SELECT "K", rep AS id, list(gene ORDER BY rank) AS genes FROM frozen WHERE rep > 0 GROUP BY ALL),
scores AS (
  SELECT 'Original' AS source, a."K", len(list_intersect(a.genes, b.genes))::DOUBLE / len(list_distinct(list_concat(a.genes, b.genes))) AS j
  FROM lists a JOIN lists b ON a."K" = b."K" AND a.id < b.id
  UNION ALL
  SELECT 'Aggregated', a."K", len(list_intersect(a.genes, b.genes))::DOUBLE / len(list_distinct(list_concat(a.genes, b.genes)))
  FROM rep_lists a JOIN rep_lists b ON a."K" = b."K" AND a.id < b.id),
stability AS (
  SELECT "K", source || '_Jaccard_Mean' AS "Metric", avg(j) AS "Value" FROM scores GROUP BY "K", source
  UNION ALL
  SELECT "K", source || '_Jaccard_Std', stddev_pop(j) FROM scores GROUP BY "K", source)"""


@query(f'WITH {STABILITY_SQL} SELECT "K", "Metric", round("Value", 6) AS "Value" FROM stability')
def panel_stability(spark, sf_dir):
    return rounded(stability_tables(spark, sf_dir), "Value")


@query(f"""WITH {STABILITY_SQL} SELECT "K", "Metric", lower("Metric") AS metric_key, round("Value", 6) AS "Value" FROM stability""")
def metric_key(spark, sf_dir):
    return rounded(m.keyed_metrics(stability_tables(spark, sf_dir)).select("K", "Metric", "metric_key", "Value"), "Value")


STABILITY_NAMES = [f"{a}_Jaccard_{b}" for a in ("Original", "Aggregated") for b in ("Mean", "Std")]


@query(f"""WITH {STABILITY_SQL} SELECT "K", {', '.join(f'''round(coalesce(max("Value") FILTER ("Metric" = '{n}'), 0), 6) AS "{n}"''' for n in STABILITY_NAMES)}
FROM stability GROUP BY "K" """)
def stability_by_k(spark, sf_dir):
    return rounded(m.stability_by_k(stability_tables(spark, sf_dir)), *STABILITY_NAMES)
